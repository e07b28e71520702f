"""CSS text to rules and declarations, values to typed lengths and colours, styles back to CSS."""

from __future__ import annotations

import re

# Named colours of CSS level 1 and some more.
COLORS = {
    "black": "000000", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080",
    "fuchsia": "ff00ff", "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080",
    "aqua": "00ffff", "orange": "ffa500", "brown": "a52a2a", "pink": "ffc0cb", "gold": "ffd700", "crimson": "dc143c", "indigo": "4b0082", "transparent": "00000000",
}
# Absolute font sizes in rem and relative ones in em.
SIZES = {"xx-small": (0.5625, "rem"), "x-small": (0.625, "rem"), "small": (0.8125, "rem"), "medium": (1.0, "rem"), "large": (1.125, "rem"), "x-large": (1.5, "rem"), "xx-large": (2.0, "rem"), "smaller": (0.833, "em"), "larger": (1.2, "em")}
# Properties that a child takes from its parent.
INHERITED = frozenset("color font-family font-size font-style font-variant font-weight hyphens letter-spacing line-height list-style-position list-style-type orphans text-align text-indent text-transform visibility white-space widows word-spacing".split())
# What browsers do without any stylesheet.
DEFAULTS = """
h1 { font-size: 2em; font-weight: bold; margin: 0.67em 0 }
h2 { font-size: 1.5em; font-weight: bold; margin: 0.83em 0 }
h3 { font-size: 1.17em; font-weight: bold; margin: 1em 0 }
h4 { font-weight: bold; margin: 1.33em 0 }
h5 { font-size: 0.83em; font-weight: bold; margin: 1.67em 0 }
h6 { font-size: 0.67em; font-weight: bold; margin: 2.33em 0 }
p, dl, ul, ol { margin: 1em 0 }
blockquote, figure { margin: 1em 40px }
b, strong, th { font-weight: bold }
i, em, cite, var, dfn, address { font-style: italic }
pre { white-space: pre; font-family: monospace; margin: 1em 0 }
code, kbd, samp, tt { font-family: monospace }
u, ins { text-decoration: underline }
s, strike, del { text-decoration: line-through }
sub { vertical-align: sub; font-size: smaller }
sup { vertical-align: super; font-size: smaller }
small { font-size: smaller }
"""
_LENGTH = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(px|em|rem|%|pt|ex)?", re.I)
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_DECLARATION = re.compile(r"""((?:[^;"'()]|"(?:\\.|[^"])*"|'(?:\\.|[^'])*'|\((?:[^()]|\([^()]*\))*\))+)""")


def length(text: str) -> tuple[str, float | None] | None:
    """(unit, value): px, em, rem or %; pt and ex are converted, a bare 0 is 0 px; other units are no length."""
    text = text.strip().lower()
    if text == "auto":
        return "auto", None
    if text in SIZES:
        return SIZES[text][1], SIZES[text][0]
    m = _LENGTH.fullmatch(text)
    if not m:
        return None
    value, unit = float(m.group(1)), m.group(2)
    if unit is None:
        return ("px", 0.0) if value == 0 else None
    if unit == "pt":
        return "px", value * 96 / 72
    if unit == "ex":
        return "em", value * 0.5
    return unit, value


def color(text: str) -> str | None:
    """Eight hex digits, red green blue alpha; none if it isn't a colour."""
    text = text.strip().lower()
    h = COLORS.get(text) or (text[1:] if re.fullmatch("#[0-9a-f]+", text) else None)
    if h is not None:
        if len(h) in (3, 4):
            h = "".join(c * 2 for c in h)
        return (h + "ff")[:8] if len(h) in (6, 8) else None
    m = re.fullmatch(r"rgba?\(([^)]*)\)", text)
    if not m:
        return None
    parts = [p for p in re.split(r"[\s,/]+", m.group(1).strip()) if p]
    if len(parts) not in (3, 4):
        return None
    try:
        channels = [round(float(p[:-1]) * 2.55) if p.endswith("%") else round(float(p)) for p in parts[:3]]
        alpha = 255 if len(parts) == 3 else round(255 * (float(parts[3][:-1]) / 100 if parts[3].endswith("%") else float(parts[3])))
    except ValueError:
        return None
    return "".join(f"{min(255, max(0, c)):02x}" for c in (*channels, alpha))


def _box(name: str, value: str) -> list[tuple[str, str]]:
    parts = value.split()
    if not 1 <= len(parts) <= 4:
        return []
    top, right, bottom, left = (parts * 4)[:4] if len(parts) == 1 else (parts[0], parts[1], parts[0], parts[1]) if len(parts) == 2 else (parts[0], parts[1], parts[2], parts[1]) if len(parts) == 3 else parts
    where = f"{name}-%s" if name in ("margin", "padding") else "border-%s-" + name.split("-")[1]
    return [(where % side, v) for side, v in (("top", top), ("right", right), ("bottom", bottom), ("left", left))]


def expand(name: str, value: str) -> list[tuple[str, str]]:
    """A shorthand as its single properties; any other declaration as it is."""
    if name in ("margin", "padding", "border-width", "border-style", "border-color"):
        return _box(name, value)
    if name == "border" or re.fullmatch("border-(top|right|bottom|left)", name):
        sides = ("top", "right", "bottom", "left") if name == "border" else (name[7:],)
        out = []
        for part in value.split():
            kind = "color" if color(part) else "width" if length(part) or part in ("thin", "medium", "thick") else "style"
            out += [(f"border-{s}-{kind}", part) for s in sides]
        return out
    if name == "background":
        found = next((p for p in value.split() if color(p)), None)
        return [("background-color", found)] if found else []
    if name == "list-style":
        return [("list-style-position" if p in ("inside", "outside") else "list-style-type", p) for p in value.split() if not p.startswith("url")]
    if name == "font":
        m = re.match(r"(?P<pre>.*?)(?P<size>\S+?)(?:\s*/\s*(?P<line>\S+))?\s+(?P<family>[^\d/]+)$", value)
        if not m or not (length(m["size"])):
            return []
        out = [("font-size", m["size"]), ("font-family", m["family"].strip())]
        for p in m["pre"].split():
            out.append(("font-style" if p in ("italic", "oblique") else "font-variant" if p == "small-caps" else "font-weight", p))
        return out + ([("line-height", m["line"])] if m["line"] else [])
    return [(name, value)]


def declarations(text: str | None) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a declaration block; broken ones are skipped."""
    out = []
    for part in _DECLARATION.findall(_COMMENT.sub("", text or "")):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not value or not re.fullmatch(r"-{0,2}[a-z][a-z0-9-]*", name):
            continue
        important = bool(re.search(r"!\s*important$", value, re.I))
        value = re.sub(r"\s*!\s*important$", "", value, flags=re.I)
        out += [(n, v, important) for n, v in expand(name, value)]
    return out


def specificity(selector: str) -> tuple[int, int, int]:
    bare = re.sub(r"\[[^\]]*\]", "", selector)
    ids = len(re.findall(r"#[\w-]+", bare))
    classes = len(re.findall(r"\.[\w-]+", bare)) + selector.count("[") + len(re.findall(r"(?<!:):(?!:)(?!not)[\w-]+", bare))
    elements = len(re.findall(r"(?:^|[\s>+~(])[a-zA-Z][\w-]*", bare)) + len(re.findall(r"::[\w-]+", bare))
    return ids, classes, elements


def rules(text: str | None) -> list[tuple[str, str]]:
    """(selector, block) of a stylesheet, in order; at-rules other than @media are skipped whole, bad rules dropped."""
    text = _COMMENT.sub("", text or "")
    out, at, n = [], 0, len(text)
    while at < n:
        start = re.compile(r"[{;]").search(text, at)
        if not start:
            break
        head = text[at : start.start()].strip()
        if start.group() == ";":
            at = start.end()
            continue
        depth, i = 1, start.end()
        while i < n and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        body = text[start.end() : i - 1 if depth == 0 else n]
        if head.startswith("@"):
            if head.lower().startswith("@media") and "print" not in head.lower():
                out += rules(body)
        else:
            out += [(s.strip(), body) for s in re.split(r",(?![^(\[]*[)\]])", head) if s.strip()]
        at = i
    return out


def font_faces(text: str | None) -> list[dict[str, str]]:
    """The @font-face rules: family, weight, style and the first url of src."""
    out = []
    for body in re.findall(r"@font-face\s*\{([^}]*)\}", _COMMENT.sub("", text or ""), re.I):
        d = {n: v for n, v, _ in declarations(body)}
        src = re.search(r"url\(\s*['\"]?([^'\")]+)", d.get("src", ""))
        if "font-family" in d and src:
            out.append({"family": d["font-family"].strip("\"' "), "weight": d.get("font-weight", "normal"), "style": d.get("font-style", "normal"), "src": src.group(1)})
    return out


def to_css(style: dict[str, str], default: dict[str, str] | None = None) -> str:
    """The properties that differ from the default, sorted by name."""
    default = default or {}
    return " ".join(f"{k}: {v};" for k, v in sorted(style.items()) if default.get(k) != v)
