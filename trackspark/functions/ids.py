"""Video identifiers and URLs as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = "[A-Za-z0-9_-]{11}"
#: Hosts, and first path segments before an identifier, that the service accepts. Fixed values.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com")
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
PREFIXES = ("shorts", "live", "embed", "v", "e")


def canonical_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


def is_video_id(s: Column) -> Column:
    return s.rlike(rf"^(?:{ID}|local-[0-9a-f]{{11}})$")


def local_id(path: Column) -> Column:
    return F.concat(F.lit("local-"), F.substring(F.sha1(path), 1, 11))


def safe_id(s: Column) -> Column:
    cut = F.substring(F.regexp_replace(s, "[^A-Za-z0-9_-]", "_"), 1, 64)
    return F.coalesce(F.when(cut != "", cut), F.lit("local"))


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, host in lower case, path segments, query."""
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?"
    part = lambda k: F.regexp_extract(url, form, k)
    return F.lower(part(1)), F.lower(part(2)), F.array_remove(F.split(part(3), "/"), ""), part(4)


def _query_v(query: Column) -> Column:
    v = F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)
    return F.when(v != "", v)


def normalize_url(url: Column) -> Column:
    """struct<video_id, url, error> by the service's allow-list of hosts and paths."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.instr(raw, "://") > 0, raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme, host, seg, query = _parts(full)
    watch = (F.size(seg) == 1) & (F.get(seg, F.lit(0)) == "watch")
    found = F.when(host.isin(*SHORT_HOSTS), F.get(seg, F.lit(0))).when(host.isin(*HOSTS) & watch, _query_v(query)).when(host.isin(*HOSTS) & (F.size(seg) >= 2) & F.get(seg, F.lit(0)).isin(*PREFIXES), F.get(seg, F.lit(1)))
    other = ~scheme.isin("http", "https") | ~host.isin(*HOSTS, *SHORT_HOSTS)
    ok = ~other & F.coalesce(found.rlike(f"^{ID}$"), F.lit(False))
    error = F.when(raw == "", "empty url").when(other, "not a video URL").when(~ok, "no video id in the URL")
    return F.struct(F.when(error.isNull(), found).alias("video_id"), F.when(error.isNull(), canonical_url(found)).alias("url"), error.alias("error"))


def extract_id(s: Column) -> Column:
    """The pipeline's lenient rule: a bare identifier, a URL whose host holds the name, or a file name that begins with one."""
    s = F.trim(s)
    _, host, seg, query = _parts(s)
    ok = lambda c: F.when(c.rlike(f"^{ID}$"), c)
    path = F.when((F.size(seg) >= 2) & F.get(seg, F.lit(0)).isin("shorts", "embed", "live", "v"), ok(F.get(seg, F.lit(1))))
    url = F.when(host.endswith("youtu.be"), ok(F.get(seg, F.lit(0)))).when(host.contains("youtube"), F.coalesce(ok(_query_v(query)), path))
    stem = F.split(F.element_at(F.split(s, "/"), -1), r"\.")[0]
    name = F.regexp_extract(stem, rf"^({ID})(?:$|[_.])", 1)
    return F.when(s.rlike(f"^{ID}$"), s).when(F.instr(s, "://") > 0, url).otherwise(F.when(name != "", name))


def overlay_id(url: Column) -> Column:
    """The page's rule: the watch path of the site or a subdomain only."""
    _, host, seg, query = _parts(url)
    v = _query_v(query)
    return F.when(host.rlike(r"(^|\.)youtube\.com$") & (F.array_join(seg, "/") == "watch") & v.rlike(f"^{ID}$"), v)


def tail_id(url: Column) -> Column:
    """The v parameter or else the last path segment, unchecked."""
    _, _, seg, query = _parts(url)
    return F.coalesce(_query_v(query), F.try_element_at(seg, F.lit(-1)))


def flag_names(flags: Column) -> Column:
    """Names of a bit mask joined by +, or - for none."""
    bit = lambda b, name: F.when(flags.bitwiseAND(b) != 0, name)
    names = F.concat_ws("+", bit(1, "interp"), bit(2, "bounce"), bit(4, "hit"))
    return F.when(names == "", "-").otherwise(names)


def ring_or_default(ring: Column, default: str) -> Column:
    return F.when(ring.rlike("^#[0-9a-fA-F]{6}$"), F.lower(ring)).otherwise(default)


def range_tag(start: Column, end: Column) -> Column:
    return F.concat(F.coalesce(start.cast("string"), F.lit("0")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("end")))
