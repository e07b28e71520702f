"""Scalar text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def normalize_spaces(s: Column) -> Column:
    """Each run of white space becomes one space, at the edges too."""
    return F.regexp_replace(s, SPACES, " ")


def strip_invisible(s: Column) -> Column:
    """Without soft hyphens and zero-width spaces."""
    return F.regexp_replace(s, "[­​]", "")


def slugify(s: Column) -> Column:
    """ASCII letters and digits in lower case; spaces, hyphens and underscores become one hyphen; the rest goes."""
    low = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = F.regexp_replace(F.regexp_replace(low, r"(?U)[\s_-]", "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def markdown_escape(s: Column) -> Column:
    """Characters that Markdown would read are escaped: some anywhere, some at the start of a line."""
    out = F.regexp_replace(s, r"([\\*_\[\]`|<>])", r"\\$1")
    out = F.regexp_replace(out, r"!(?=\\\[)", r"\\!")
    out = F.regexp_replace(out, r"(?m)^#", r"\\#")
    out = F.regexp_replace(out, r"(?m)^(?=(?:-+|=+)[ \t]*$)", r"\\")
    out = F.regexp_replace(out, r"(?m)^([-+])(?=[ \t]|$)", r"\\$1")
    return F.regexp_replace(out, r"(?m)^(\d+)([.)])(?=[ \t]|$)", r"$1\\$2")


def _longest_ticks(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))


def fence_length(s: Column) -> Column:
    """Backticks of a fence that no run inside can end: three at least."""
    return F.greatest(_longest_ticks(s), F.lit(2)) + 1


def inline_ticks(s: Column) -> Column:
    return _longest_ticks(s) + 1


def link_destination(s: Column) -> Column:
    """In angle brackets where it holds white space, control characters or unbalanced parentheses."""
    depth = F.aggregate(
        F.filter(F.split(s, ""), lambda c: c.isin("(", ")")),
        F.struct(F.lit(0).alias("open"), F.lit(False).alias("bad")),
        lambda a, c: F.struct((a["open"] + F.when(c == "(", 1).otherwise(-1)).alias("open"), (a["bad"] | ((c == ")") & (a["open"] == 0))).alias("bad")),
    )
    wrap = s.rlike(r"(?U)[\s\p{Cntrl}]") | depth["bad"] | (depth["open"] != 0)
    return F.when(wrap, F.concat(F.lit("<"), F.regexp_replace(s, "([<>])", r"\\$1"), F.lit(">"))).otherwise(s)


def xml_escape(s: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def xml_unescape(s: Column) -> Column:
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


# Media types by file extension.
MEDIA = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp",
    "css": "text/css", "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml", "ncx": "application/x-dtbncx+xml",
    "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2", "js": "text/javascript",
}
# First bytes, as hex, of the media that tell themselves.
MAGIC = {"FFD8FF": "image/jpeg", "89504E47": "image/png", "47494638": "image/gif", "774F4646": "font/woff", "774F4632": "font/woff2", "00010000": "font/ttf", "4F54544F": "font/otf"}
# Formats by file extension.
FORMATS = {"epub": "epub", "azw3": "azw3", "mobi": "mobi", "azw": "mobi", "kfx": "kfx", "md": "markdown", "txt": "markdown"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def media_type(path: Column, content: Column | None = None) -> Column:
    """By extension, else by the first bytes, else binary."""
    found = _mapped(extension(path), MEDIA)
    if content is not None:
        for head, kind in MAGIC.items():
            found = F.coalesce(found, F.when(F.hex(F.substring(content, 1, len(head) // 2)) == head, kind))
    return F.coalesce(found, F.lit("application/octet-stream"))


def format_of(path: Column) -> Column:
    """The book format of a path; null where it is none."""
    return _mapped(extension(path), FORMATS)


def date_prefix(s: Column) -> Column:
    return F.substring_index(s, "T", 1)


def content_id(s: Column) -> Column:
    return F.upper(F.substring(F.sha1(s), 1, 32))


def book_token(s: Column) -> Column:
    """URL-safe base64 of a 5 and the first 16 bytes of the SHA-1."""
    raw = F.unhex(F.concat(F.lit("05"), F.substring(F.sha1(s), 1, 32)))
    return F.rtrim(F.translate(F.base64(raw), "+/=", "-_"))


def uid(identifier: Column, title: Column) -> Column:
    """The first four bytes of the SHA-1 of both, as a number."""
    return F.conv(F.substring(F.sha1(F.concat(identifier, F.lit("\n"), title)), 1, 8), 16, 10).cast("bigint")


def file_title(s: Column) -> Column:
    return F.replace(F.regexp_replace(s, "[^A-Za-z0-9 _-]", ""), F.lit(" "), F.lit("_"))


def _folded(parts: Column) -> Column:
    """Path parts with . and empty ones left out and .. taking back the one before, if any."""
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )


def resolve_path(base: Column, relative: Column, root: bool = False) -> Column:
    """A relative reference against a document's path; its fragment stays.

    Absolute paths and URLs come back as they are; with root a leading slash means the archive's
    root. ".." above the root is ignored."""
    rel = F.replace(relative, F.lit("\\"), F.lit("/"))
    path, fragment = F.substring_index(rel, "#", 1), F.when(F.instr(rel, "#") > 0, F.concat(F.lit("#"), F.substring_index(rel, "#", -1))).otherwise("")
    folder = F.regexp_replace(base, "[^/]*$", "")
    joined = F.array_join(_folded(F.split(F.concat(folder, path), "/")), "/")
    out = F.when(F.startswith(rel, F.lit("#")), F.concat(base, rel)).when(rel.contains("://") | rel.rlike("^(?:data|mailto):"), relative)
    if root:
        out = out.when(F.startswith(rel, F.lit("/")), F.concat(F.array_join(_folded(F.split(path, "/")), "/"), fragment))
    else:
        out = out.when(F.startswith(rel, F.lit("/")), relative)
    return out.otherwise(F.concat(joined, fragment))


def output_path(s: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(F.replace(s, F.lit("\\"), F.lit("/")), "^/+", ""), F.lit("//"), F.lit("/")), "^/+", "")


def base32(n: Column, digits: int) -> Column:
    return F.lpad(F.conv(n.cast("string"), 10, 32), digits, "0")


def from_base32(s: Column) -> Column:
    return F.conv(s, 32, 10).cast("bigint")


def repair_solidus(s: Column) -> Column:
    """A slash between two attributes moves to the end of its tag."""
    return F.regexp_replace(s, r"""<(\w+)((?:\s+[\w:-]+=(?:"[^"]*"|'[^']*'))+)/(\s+[^<>/]*?)\s*/?>""", r"<$1$2$3/>")


def summary(s: Column, n: int = 300) -> Column:
    """The first n characters on one line, with dots where there is more."""
    flat = F.replace(F.trim(s), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def truncated(s: Column, n: int) -> Column:
    flat = F.trim(normalize_spaces(s))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def words(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(s)), SPACES), lambda w: w != ""))


def fuzzy_title(a: Column, b: Column) -> Column:
    """Jaccard of the word sets, or half and half the length ratio where one contains the other."""
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    jaccard = F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)
    low_a, low_b = F.lower(F.trim(a)), F.lower(F.trim(b))
    holds = (low_a.contains(low_b) | low_b.contains(low_a)) & (F.length(low_a) > 0) & (F.length(low_b) > 0)
    ratio = F.least(F.length(low_a), F.length(low_b)) / F.greatest(F.length(low_a), F.length(low_b))
    return F.greatest(jaccard, F.when(holds, 0.5 + 0.5 * ratio).otherwise(0.0))


def series_position(p: Column) -> Column:
    return F.when(p == F.floor(p), F.floor(p).cast("bigint").cast("string")).otherwise(p.cast("string"))


def retention_words(s: Column) -> Column:
    """Distinct words of four letters or digits and more, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)), F.lower))


def word_retention(source: Column, other: Column) -> Column:
    a, b = retention_words(source), retention_words(other)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def without_file_links(html: Column) -> Column:
    """Links to plain file names, which lead nowhere in a book of one file, lose their href."""
    return F.regexp_replace(html, r"""(?i)(<a\b[^>]*?)\s+href\s*=\s*(?:"[^"#:/]+\.(?:x?html?|xml)"|'[^'#:/]+\.(?:x?html?|xml)')""", "$1")


def without_reader_attributes(html: Column) -> Column:
    """Attributes that an e-reader's tools left (aid, data-Amzn...) are dropped."""
    return F.regexp_replace(html, r"""(?i)\s+(?:aid|data-amzn[\w-]*)\s*=\s*(?:"[^"]*"|'[^']*')""", "")


def with_alternatives(html: Column) -> Column:
    """Images without an alt attribute get an empty one."""
    return F.regexp_replace(html, r"(?i)<img\b(?![^>]*\salt\s*=)", '<img alt=""')


def without_namespaces(html: Column) -> Column:
    """Namespace declarations and attributes with a prefix are dropped, but for xml:lang."""
    return F.regexp_replace(html, r"""\s+(?:xmlns(?::[\w-]+)?|(?!xml:lang\b)[\w-]+:[\w-]+)\s*=\s*(?:"[^"]*"|'[^']*')""", "")


def without_at_rules(css: Column) -> Column:
    """Style sheets without the rules that old readers can't parse; @media, @font-face, @page and @import stay."""
    dropped = r"(?is)@(?!media\b|font-face\b|page\b|import\b|charset\b)[\w-]+[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})"
    return F.regexp_replace(css, dropped, "")


def wrapped_html(body: Column, title: Column) -> Column:
    """A piece of a book as a whole XHTML document; what is one already stays."""
    whole = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), xml_escape(F.coalesce(title, F.lit(""))), F.lit("</title></head><body>"), F.coalesce(body, F.lit("")), F.lit("</body></html>"))
    return F.when(body.rlike(r"(?is)^\s*(?:<\?xml[^>]*>\s*)?(?:<!doctype[^>]*>\s*)?<html\b"), body).otherwise(whole)


def container_id(seed: Column) -> Column:
    """A container's name, the same for the same seed: CR! and 28 characters of its digest in base 32."""
    return F.concat(F.lit("CR!"), F.upper(F.substring(F.translate(F.sha1(F.coalesce(seed, F.lit("")).cast("binary")), "abcdef", "GHJKLM"), 1, 28)))
