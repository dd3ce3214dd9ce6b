"""The seven target regions and their classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import address_key, trim

#: Regions in their order, and the districts of the first.
REGIONS = ("대전", "세종", "청주", "공주", "보령", "아산", "천안")
DISTRICTS = ("대덕구", "동구", "서구", "유성구", "중구")
#: How a key begins that counts for a region, whose label is the last two letters: 대전 with a district after it only.
_PREFIX = f"^(?:대전(?={'|'.join(DISTRICTS)})|세종|(?:충북)?청주|(?:충남)?(?:{'|'.join(REGIONS[3:])}))"
_DISTRICT, _CITY = f"(?:{'|'.join(DISTRICTS)})", f"(?:{'|'.join(REGIONS[3:])})"
#: Whole region texts as keys, and the words with which an address begins.
_REGION_TEXT = rf"^(?:대전{_DISTRICT}?|세종시|충북청주시|충남{_CITY}시)\z"
_ADDRESS = rf"(?U)^(?:대전(?:광역시|\s+광역시)?\s+{_DISTRICT}|세종(?:시|특별자치시)?|(?:충북|충청북도)\s+청주시|(?:충남|충청남도)\s+(?:{_CITY}시|천안\s+서북구))(?=\s|\z)"


def _label(c: Column) -> Column:
    """The first label in a text that is known to have one."""
    return F.regexp_extract(c, "|".join(REGIONS), 0)


def of_region_text(c: Column) -> Column:
    """Strict vocabulary of the feed's region column, or null."""
    k = address_key(c)
    return F.when(k.rlike(_REGION_TEXT), _label(k))


def of_address(c: Column) -> Column:
    """Strict reading of an address by its words, or null."""
    t = trim(c)
    return F.when(t.rlike(_ADDRESS), _label(t))


def strict(region: Column, address: Column) -> tuple[Column, Column]:
    """(region, state): both agree, neither is known (dropped), or a contradiction of one of three kinds."""
    a, b = of_region_text(region), of_address(address)
    state = F.when(a.isNull() & b.isNull(), "dropped").when(a.isNull(), "address only").when(b.isNull(), "region only").when(a == b, "ok").otherwise("disagree")
    return F.when(a == b, a), state


def flexible(region: Column, address: Column) -> Column:
    """For counting master rows: by the region's prefix unless it is just 대전, by the address's, then by a bare district."""
    return flexible_of_keys(address_key(region), address_key(address))


def flexible_of_keys(r: Column, a: Column) -> Column:
    """The same from address keys; each is used many times, so let them be columns that are computed already."""

    def prefix(c: Column) -> Column:
        return F.nullif(F.right(F.regexp_extract(c, _PREFIX, 0), F.lit(2)), F.lit(""))

    return F.coalesce(F.when(r != REGIONS[0], prefix(r)), prefix(a), F.when((r == REGIONS[0]) & a.rlike(f"^({'|'.join(DISTRICTS)})"), REGIONS[0]))
