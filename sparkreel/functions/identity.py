"""Source locations: video host, video id, project identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkreel.functions.text import or_default, strip

# Hosts, path heads and the id shape of the supported video site.
SHORT_LINK_HOSTS = ["youtu.be", "www.youtu.be"]
WATCH_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com"]
ID_PATH_HEADS = ["shorts", "embed", "live"]
VIDEO_ID = r"\A[A-Za-z0-9_-]{6,100}\z"
DIGEST_LENGTH = 16
NAME_LENGTH = 40

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _clean_url(location: Column) -> Column:
    """Without leading control characters and blanks, and without tabs and line breaks."""
    return F.regexp_replace(F.regexp_replace(location, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def host(location: Column) -> Column:
    """Lower-case host without user and port; empty when the location names none."""
    authority = F.regexp_extract(_clean_url(location), _AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":.*$", ""))


def source_type(location: Column) -> Column:
    return F.when(host(location).isin(SHORT_LINK_HOSTS + WATCH_HOSTS), F.lit("youtube")).otherwise(
        F.lit("local")
    )


def _query_value(location: Column, name: str) -> Column:
    """First non-blank value of a query parameter, percent-decoded."""

    def decoded(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    pairs = F.split(F.regexp_extract(_clean_url(location), _QUERY, 1), "&")
    named = F.filter(pairs, lambda pair: decoded(F.regexp_extract(pair, "^([^=]*)=.", 1)) == name)
    return decoded(F.regexp_extract(F.get(named, F.lit(0)), "^[^=]*=(.*)$", 1))


def video_id(location: Column) -> Column:
    """Id of the video a location points at, or NULL."""
    path = F.regexp_replace(F.regexp_extract(_clean_url(location), _PATH, 1), ";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    head = F.get(F.split(F.btrim(path, F.lit("/")), "/"), F.lit(0))
    by_path = F.when(F.get(parts, F.lit(0)).isin(ID_PATH_HEADS), F.get(parts, F.lit(1)))
    found = F.when(host(location).isin(SHORT_LINK_HOSTS), head).when(
        host(location).isin(WATCH_HOSTS), F.coalesce(_query_value(location, "v"), by_path)
    )
    return F.when(found.rlike(VIDEO_ID), found)


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGEST_LENGTH)


def _local_path(location: Column) -> Column:
    """An absolute path with repeated separators, ``/./`` and a trailing separator removed."""
    single = F.regexp_replace(location, r"/(?:\./|/)*", "/")
    return F.when(single == "/", single).otherwise(F.regexp_replace(single, r"/\.?$", ""))


def _readable_name(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    cleaned = F.btrim(F.regexp_replace(stem, r"[^\p{L}\p{N}_\-]+", "_"), F.lit("_"))
    return or_default(F.right(cleaned, F.lit(NAME_LENGTH)), F.lit("local_file"))


def source_identity(location: Column) -> Column:
    """``struct(project_id, identity)``: one project per video, whatever its spelling."""
    site_url = strip(location)
    path = _local_path(location)
    lowered = F.lower(path)
    vid = video_id(location)
    is_site = source_type(location) == "youtube"
    project = (
        F.when(is_site & vid.isNotNull(), F.concat(F.lit("youtube_"), vid))
        .when(is_site, F.concat(F.lit("youtube_"), _digest(site_url)))
        .otherwise(F.concat(F.lit("local_"), _readable_name(path), F.lit("_"), _digest(lowered)))
    )
    identity = (
        F.when(is_site & vid.isNotNull(), F.concat(F.lit("youtube:"), vid))
        .when(is_site, F.concat(F.lit("youtube_url:"), site_url))
        .otherwise(F.concat(F.lit("local:"), lowered))
    )
    return F.struct(project.alias("project_id"), identity.alias("identity"))
