"""MathML to an expression tree, and that to LaTeX, plain text and MathML again.

A tree is nested lists: [kind, content...], where content is text or trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

# Symbols and their LaTeX commands.
SYMBOLS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi",
    "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega", "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda",
    "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega", "∑": "sum", "∏": "prod", "∫": "int", "∞": "infty", "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx",
    "×": "times", "÷": "div", "±": "pm", "·": "cdot", "→": "to", "←": "leftarrow", "⇒": "Rightarrow", "∈": "in", "∉": "notin", "⊂": "subset", "⊆": "subseteq",
    "∪": "cup", "∩": "cap", "∂": "partial", "∇": "nabla", "∀": "forall", "∃": "exists", "¬": "neg", "∧": "wedge", "∨": "vee", "…": "ldots", "−": "-",
}
# Names that LaTeX sets upright.
FUNCTIONS = frozenset("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln exp lim max min sup inf det gcd dim ker".split())
# Raised and lowered forms.
SUPER = dict(zip("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", strict=True))
SUB = dict(zip("0123456789+-=()aeox", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ", strict=True))
# Elements with a set number of parts, and their names in a tree.
PARTS = {"mfrac": "frac", "msup": "sup", "msub": "sub", "msubsup": "subsup", "mover": "over", "munder": "under", "munderover": "underover", "mroot": "root"}
ACCENTS = {"^": "hat", "ˆ": "hat", "¯": "bar", "‾": "bar", "→": "vec", "⃗": "vec", "~": "tilde", "˜": "tilde", "˙": "dot"}
_KINDS = {"mi": "id", "mn": "num", "mo": "op", "mtext": "text", "ms": "text"}


def parse(mathml: str) -> list:
    """The tree of a MathML text; unknown elements are kept as raw with their text."""

    def tree(e: ElementTree.Element) -> list:
        tag = e.tag.rsplit("}", 1)[-1]
        if tag in _KINDS:
            return [_KINDS[tag], (e.text or "").strip()]
        kids = [tree(x) for x in e if x.tag.rsplit("}", 1)[-1] not in ("annotation", "annotation-xml")]
        if tag in PARTS:
            return [PARTS[tag], *kids]
        if tag == "msqrt":
            return ["sqrt", *kids]
        if tag == "mtable":
            return ["table", *kids]
        if tag in ("mtr", "mtd"):
            return [{"mtr": "row", "mtd": "cell"}[tag], *kids]
        if tag == "mfenced":
            return ["fenced", e.get("open", "("), e.get("close", ")"), *kids]
        if tag == "mspace":
            return ["space"]
        if tag in ("math", "mrow", "mstyle", "semantics", "mpadded", "mphantom", "merror"):
            return kids[0] if len(kids) == 1 else ["rowof", *kids]
        return ["raw", tag, "".join(e.itertext())]

    return tree(ElementTree.fromstring(mathml))  # noqa: S314


def to_latex(t: list) -> str:
    kind, *c = t
    group = lambda x: "{" + to_latex(x) + "}"
    if kind == "id":
        name = c[0]
        return "\\" + SYMBOLS[name] if SYMBOLS.get(name, "-") != "-" else "\\" + name if name in FUNCTIONS else name if len(name) < 2 else "\\mathrm{" + name + "}"
    if kind == "op":
        s = SYMBOLS.get(c[0])
        return "-" if s == "-" else "\\" + s if s else {"{": "\\{", "}": "\\}", "%": "\\%", "&": "\\&"}.get(c[0], c[0])
    if kind == "num":
        return c[0]
    if kind == "text":
        return "\\text{" + re.sub(r"([#$%&_{}])", r"\\\1", c[0]) + "}"
    if kind == "frac":
        return "\\frac" + group(c[0]) + group(c[1])
    if kind in ("sup", "sub"):
        base = to_latex(c[0]) if c[0][0] in ("id", "num", "op") else group(c[0])
        return base + ("^" if kind == "sup" else "_") + group(c[1])
    if kind in ("subsup", "underover"):
        return to_latex(c[0]) + "_" + group(c[1]) + "^" + group(c[2])
    if kind == "over":
        accent = ACCENTS.get(c[1][1]) if c[1][0] == "op" else None
        return "\\" + accent + group(c[0]) if accent else "\\overset" + group(c[1]) + group(c[0])
    if kind == "under":
        return to_latex(c[0]) + "_" + group(c[1]) if c[0][0] == "op" else "\\underset" + group(c[1]) + group(c[0])
    if kind == "sqrt":
        return "\\sqrt{" + _joined(c) + "}"
    if kind == "root":
        return "\\sqrt[" + to_latex(c[1]) + "]" + group(c[0])
    if kind == "fenced":
        return "\\left" + c[0] + ",".join(map(to_latex, c[2:])) + "\\right" + c[1]
    if kind == "table":
        return "\\begin{matrix}" + " \\\\ ".join(to_latex(r) for r in c) + "\\end{matrix}"
    if kind == "row":
        return " & ".join(to_latex(x) for x in c)
    if kind == "space":
        return "\\,"
    if kind == "raw":
        return "\\text{" + c[1] + "}"
    return _joined(c)


def _joined(parts: list) -> str:
    out = ""
    for p in map(to_latex, parts):
        out += (" " if re.search(r"\\[A-Za-z]+$", out) and p[:1].isalpha() else "") + p
    return out


def to_text(t: list) -> str:
    """Plain text; raised and lowered forms where all characters have one, else braces."""
    kind, *c = t
    if kind in ("id", "op", "num", "text"):
        return c[0]
    if kind in ("sup", "sub", "subsup"):
        out = to_text(c[0])
        for part, forms in zip(c[1:], {"sup": [SUPER], "sub": [SUB], "subsup": [SUB, SUPER]}[kind], strict=True):
            s = to_text(part)
            out += "".join(forms[x] for x in s) if s and all(x in forms for x in s) else "{" + s + "}"
        return out
    if kind == "frac":
        return f"({to_text(c[0])})/({to_text(c[1])})"
    if kind == "sqrt":
        return "√(" + "".join(map(to_text, c)) + ")"
    if kind == "root":
        return f"{to_text(c[1])}√({to_text(c[0])})"
    if kind == "fenced":
        return c[0] + ",".join(map(to_text, c[2:])) + c[1]
    if kind == "space":
        return " "
    if kind == "raw":
        return c[1]
    glue = {"table": "; ", "row": ", "}.get(kind, "")
    return glue.join(to_text(x) for x in c)


def to_mathml(t: list) -> str:
    kind, *c = t
    back = {v: k for k, v in PARTS.items()} | {"sqrt": "msqrt", "table": "mtable", "row": "mtr", "cell": "mtd", "rowof": "mrow"}
    if kind in ("id", "op", "num", "text"):
        tag = {v: k for k, v in _KINDS.items() if k != "ms"}[kind]
        return f"<{tag}>{escape(c[0])}</{tag}>"
    if kind == "fenced":
        return f'<mfenced open="{escape(c[0])}" close="{escape(c[1])}">' + "".join(map(to_mathml, c[2:])) + "</mfenced>"
    if kind == "space":
        return "<mspace/>"
    if kind == "raw":
        return f"<{c[0]}>{escape(c[1])}</{c[0]}>"
    return f"<{back[kind]}>" + "".join(map(to_mathml, c)) + f"</{back[kind]}>"


_LATEX = re.compile(r"\\[A-Za-z]+|\\.|[{}^_&]|\d+(?:\.\d+)?|\S")
_COMMAND = {v: k for k, v in SYMBOLS.items() if v != "-"}


def from_latex(latex: str) -> list:
    """The tree of a LaTeX subset: groups, scripts, fractions, roots, symbols, functions, text."""
    m = re.compile(r"\\text\{([^}]*)\}")
    texts: list[str] = []
    latex = m.sub(lambda x: f"\\TEXT{{{texts.append(x.group(1)) or len(texts) - 1}}}", latex)
    tokens: Iterator[str] = iter(_LATEX.findall(latex))
    ahead: list[str] = []

    def peek() -> str | None:
        if not ahead:
            x = next(tokens, None)
            if x is None:
                return None
            ahead.append(x)
        return ahead[0]

    def take() -> str:
        x = peek()
        if x is None:
            raise ValueError("LaTeX ends early")
        return ahead.pop()

    def group() -> list:
        if peek() == "{":
            take()
            inner = row("}")
            take()
            return inner
        return atom()

    def atom() -> list:
        x = take()
        if x == "{":
            ahead.append(x)
            return group()
        if x == "\\frac":
            return ["frac", group(), group()]
        if x == "\\sqrt":
            if peek() == "[":
                take()
                index = row("]")
                take()
                return ["root", group(), index]
            return ["sqrt", group()]
        if x == "\\TEXT":
            return ["text", texts[int(group()[1])]]
        if x == "\\mathrm":
            inner = group()
            return ["id", "".join(p[1] for p in (inner[1:] if inner[0] == "rowof" else [inner]))]
        if x.startswith("\\"):
            name = x[1:]
            if name in FUNCTIONS:
                return ["id", name]
            if name in _COMMAND:
                return ["id" if _COMMAND[name].isalpha() else "op", _COMMAND[name]]
            return ["op", name] if len(name) == 1 else ["raw", name, name]
        return ["num", x] if x[0].isdigit() else ["id", x] if x.isalpha() else ["op", x]

    def row(stop: str | None) -> list:
        out = []
        while (x := peek()) is not None and x != stop:
            item = atom()
            low = high = None
            while peek() in ("^", "_"):
                if take() == "^":
                    high = group()
                else:
                    low = group()
            out.append(["subsup", item, low, high] if low and high else ["sup", item, high] if high else ["sub", item, low] if low else item)
        return out[0] if len(out) == 1 else ["rowof", *out]

    return row(None)
