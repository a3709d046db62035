"""Sensor ids built from tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _site(site: Column | str | None) -> Column:
    if site is None:
        return _text("siteRef")
    return F.lit(site) if isinstance(site, str) else site


def _without_site(joined: Column, site: Column) -> Column:
    # An empty site would make the pattern a lone space and eat every separator.
    return F.when(site == "", joined).otherwise(F.replace(joined, F.concat(site, F.lit(" ")), F.lit("")))


def unique_id(site: Column | str | None = None) -> Column:
    """Five tags joined by spaces, the site name removed wherever it occurs.

    ``site`` is a fixed building name; None takes each row's own ``siteRef``.
    """
    tags = ["equipRef", "groupRef", "navName", "siteRef", "typeRef"]
    return _without_site(F.concat_ws(" ", *[_text(t) for t in tags]), _site(site))


def strip_ref(c: str) -> Column:
    """Drop the id token of a reference: what follows the first space, null without a space."""
    rest = F.regexp_extract(c, "[^ ]* (.*)", 1)
    return F.when(F.col(c).contains(" "), rest)


def unique_id_metadata(site: Column | str | None = None) -> Column:
    """The same id from point metadata, whose references carry an id token."""
    parts = [
        F.coalesce(strip_ref("equipRef"), F.lit("")),
        F.coalesce(strip_ref("groupRef"), F.lit("")),
        _text("navName"),
        F.coalesce(strip_ref("siteRef"), F.lit("")),
        _text("bmsName"),
    ]
    own = F.coalesce(strip_ref("siteRef"), F.lit("")) if site is None else _site(site)
    return _without_site(F.concat_ws(" ", *parts), own)


def unique_id_flux() -> Column:
    """The dashboard's id: four tags, an inner site name collapsed to one space."""
    joined = F.concat_ws(" ", *[_text(t) for t in ["equipRef", "groupRef", "navName", "typeRef"]])
    site = _text("siteRef")
    return F.when(site == "", joined).otherwise(
        F.replace(joined, F.concat(F.lit(" "), site, F.lit(" ")), F.lit(" "))
    )
