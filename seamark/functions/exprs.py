"""Scalar rules as columns: domains, media types, rejections, rates, scores, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image types and endings that are accepted, and page-like endings that are not followed.
IMAGE_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
REJECTED_TYPES = ("image/svg+xml", "image/gif", "image/bmp", "image/tiff", "image/x-icon", "image/vnd.microsoft.icon")
IMAGE_ENDINGS = r"\.(jpg|jpeg|png|webp)"
BINARY_ENDINGS = r"\.(pdf|zip|jpg|jpeg|png|gif|webp)$"
REASONS = ("http_error", "missing_content_type", "unsupported_content_type", "file_too_small", "file_too_large", "invalid_image_payload", "image_dimensions_too_small", "missing_response")
#: Allowed moves between the states of a domain.
MOVES = {"pending": ("active", "unreachable"), "active": ("active", "exhausted", "blocked", "unreachable"), "exhausted": ("pending", "active"), "blocked": ("pending", "active"), "unreachable": ("pending", "active")}
STATUSES = tuple(MOVES)


def rounded(x: Column) -> Column:
    """A double to the nearest integer, halves to even."""
    return F.rint(x).cast("int")


def rate(a: Column, b: Column) -> Column:
    """a / b as a double, null when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def netloc(url: Column) -> Column:
    """The authority in lower case, port kept; a text without :// is read as if https:// stood before it. Null without one."""
    low = F.lower(F.trim(url))
    return F.nullif(F.regexp_extract(F.when(low.contains("://"), low).otherwise(F.concat(F.lit("https://"), low)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def canonical_ascii(url: Column) -> Column:
    """The canonical domain of an ASCII url or host: lower case, no default port, no trailing dots, one www. off."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"\.+$", "")
    return F.nullif(F.regexp_replace(plain, r"^www\.", ""), F.lit(""))


def fallback_canonical(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def media_type(content_type: Column) -> Column:
    return F.trim(F.substring_index(F.lower(content_type), ";", 1))


def type_accepted(content_type: Column) -> Column:
    return F.coalesce(media_type(content_type).isin(*IMAGE_TYPES), F.lit(False))


def type_refused(content_type: Column) -> Column:
    """Whether the type is on the list of those that are refused by name."""
    return F.coalesce(media_type(content_type).isin(*REJECTED_TYPES), F.lit(False))


def ends_like_image(url: Column) -> Column:
    """Whether the whole url, query and all, ends like an image."""
    return F.coalesce(F.lower(url).rlike(IMAGE_ENDINGS + "$"), F.lit(False))


def parseable(text_response: Column, content_type: Column, size: Column) -> Column:
    """Whether a response is read as a page: a text response, a type with html or text in it, or no type and some body."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.coalesce(text_response, F.lit(False)) | kind.contains("html") | kind.contains("text") | ((kind == "") & (F.coalesce(size, F.lit(0)) > 0))


def reason(key: Column, details: Column) -> Column:
    return F.concat_ws(": ", key, F.nullif(details, F.lit("")))


def content_type_reason(content_type: Column) -> Column:
    """Null where the type is accepted."""
    kind = media_type(content_type)
    return F.when(F.coalesce(kind, F.lit("")) == "", F.lit("missing_content_type")).when(~kind.isin(*IMAGE_TYPES), reason(F.lit("unsupported_content_type"), kind))


def rejection_class(message: Column) -> Column:
    """The counter of a rejection: what stands before the first colon if that is known, else by what it says, else unknown."""
    low = F.lower(F.coalesce(message, F.lit("")))
    prefix = F.trim(F.substring_index(low, ":", 1))
    return (
        F.when(prefix.isin(*REASONS), prefix).when(low.contains("content type") | low.contains("content-type"), "unsupported_content_type").when(low.contains("too small") & low.contains("dimension"), "image_dimensions_too_small")
        .when(low.contains("too small"), "file_too_small").when(low.contains("too large"), "file_too_large").when(low.contains("http") | low.contains("status"), "http_error").otherwise("unknown")
    )


def image_url(url: Column) -> Column:
    """Whether an absolute url is of an accepted image: by its path's end, or anywhere in its query."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(F.lower(url), r"\?([^#]*)", 1)
    return F.coalesce(F.lower(url).rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]+") & (path.rlike(IMAGE_ENDINGS + "$") | query.rlike(IMAGE_ENDINGS)), F.lit(False))


def srcset(value: Column) -> Column:
    """The urls of a srcset attribute."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.element_at(F.split(F.trim(x), r"\s+"), 1)), lambda x: x != "")


def seed_url(line: Column) -> Column:
    """A seed line with a scheme; null for blanks and comments."""
    text = F.trim(line)
    return F.when((text != "") & ~text.startswith("#"), F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text)))


def seed_key(domain: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(domain, F.lit("https://")), F.lit("http://")), "/+$", "")


def status_bucket(status: Column) -> Column:
    return F.when(status.between(200, 299), "2xx Success").when(status.between(300, 399), "3xx Redirect").when(status.between(400, 499), "4xx Client Error").when(status.between(500, 599), "5xx Server Error").otherwise("Other")


def tier(score: Column) -> Column:
    return F.when(score >= 1000, "high").when(score >= 500, "medium").when(score >= 0, "normal").otherwise("low")


def priority(as_of: Column) -> Column:
    """The score of a domain from its counters; each term is rounded by itself."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.coalesce(F.col("last_crawled_at").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")))) / F.lit(86_400_000_000.0)
    backlog = F.least(F.greatest(F.col("pages_discovered") - F.col("pages_crawled"), F.lit(0)), F.lit(500)) * 2
    return (F.coalesce(-F.col("seed_rank"), F.lit(0)) + rounded(F.coalesce(F.col("image_yield_rate"), F.lit(0.0)) * 1000) + backlog.cast("int") - rounded(F.coalesce(F.col("error_rate"), F.lit(0.0)) * 500) + rounded(days * 5)).cast("int")


def content_path(sha: Column) -> Column:
    return F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)


def final_status(pages: Column, errors: Column, blocked: Column) -> Column:
    return F.when(blocked, "blocked").when((pages == 0) & (errors > 0), "unreachable").when((pages == 0) & (errors == 0), "pending").otherwise("active")


#: Public suffixes of two labels that registrable() knows unless it is given others.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za", "com.sg", "com.hk", "com.tw", "com.ar")


def registrable(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last two labels of a host, or three where the last two are a public suffix. Hosts of fewer labels stay."""
    labels = F.split(host, r"\.")
    kept = F.when(F.substring_index(host, ".", -2).isin(*suffixes), 3).otherwise(2)
    return F.when(F.size(labels) > kept, F.array_join(F.slice(labels, F.size(labels) - kept + 1, kept), ".")).otherwise(host)


def canonical_url(url: Column) -> Column:
    """Scheme and authority in lower case, / for an empty path, query parameters sorted, no fragment: urls that ask for the same thing are equal."""
    bare = F.substring_index(F.trim(url), "#", 1)
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.substring_index(F.substring(bare, F.length(head) + 1, F.length(bare)), "?", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: x != "")), "&")
    return F.concat(F.lower(head), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def fingerprint(url: Column, method: Column | None = None) -> Column:
    """Equal for requests that ask for the same thing."""
    return F.sha2(F.concat_ws(" ", method if method is not None else F.lit("GET"), canonical_url(url)), 256)


def namespaced(key: Column, namespace: str = "") -> Column:
    return F.concat(F.lit(f"{namespace}:"), key) if namespace else key


def checkpoint_id(domain: Column, run: Column) -> Column:
    return F.concat_ws(":", domain, F.coalesce(run, F.lit("unknown")))


def log_record(level: Column, logger: Column, message: Column, at: Column, **extra: Column) -> Column:
    """One log line as JSON; extra fields follow the fixed ones, as text where they have no JSON type."""
    return F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), level.alias("level"), logger.alias("logger"), message.alias("message"), *[c.alias(n) for n, c in extra.items()]))


#: Days until a domain is due again, by state and code of the block (a design of the reference that it does not run).
COOLDOWNS = {"login_required": 30, "rate_limited": 7, "forbidden": 14, "unreachable": 7, "exhausted": 14}


def next_crawl_after(status: Column, code: Column, as_of: Column) -> Column:
    """When a blocked, unreachable or exhausted domain is due again; null for others."""
    key = F.when(status == "blocked", F.coalesce(code, F.lit("login_required"))).otherwise(status)
    days = F.element_at(F.create_map(*[F.lit(x) for kv in COOLDOWNS.items() for x in kv]), key)
    return as_of + F.make_dt_interval(days)
