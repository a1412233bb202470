"""Text parsing as column expressions: answers, numbers, letters, spans, grids. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit


def _rep(c: Column, old: str, new: str) -> Column:
    return F.replace(c, L(old), L(new))


def _sub(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, pattern, new)


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(c)`` with ``c`` evaluated once: a lambda variable over a one-element array.

    Without it, an expression that uses its input several times grows exponentially when such steps are chained.
    """
    return F.element_at(F.transform(F.array(c), fn), 1)


def let2(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: fn(s["a"], s["b"]))


def _trim(c: Column) -> Column:
    return _sub(c, r"(?U)^\s+|\s+$", "")


def _last(c: Column, pattern: str, group: int = 1) -> Column:
    """Last match of a pattern, null without a match."""
    return F.try_element_at(F.regexp_extract_all(c, L(pattern), L(group)), L(-1))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, L(pattern), L(group)), L(1))


def _occurrences(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(_rep(c, ch, ""))


# question answering

def qa_normalize(c: Column, mode: str = "") -> Column:
    """Lower case, no punctuation, no articles, single spaces; mode "mc": the last ``(X)``."""
    if mode == "mc":
        return F.coalesce(_last(c, r"(\([a-zA-Z]\))"), L(""))
    bare = _sub(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    word = r"[\p{L}\p{N}_]"
    bare = _sub(bare, rf"(?<!{word})(a|an|the)(?!{word})", " ")
    return F.trim(_sub(bare, r"\s+", " "))


def _numbered(tokens: Column) -> Column:
    """Tokens with their occurrence number, so that set intersection becomes multiset intersection."""
    return let(F.array_sort(tokens), lambda s: F.transform(s, lambda x, i: F.struct(
        x.alias("t"), (i - F.array_position(s, x)).alias("k"))))


def token_f1(pred: Column, truth: Column) -> Column:
    """struct(f1, precision, recall) of normalised tokens; yes/no/noanswer must match exactly.

    For answers: the cost grows with the square of the token count. ``scoring.score_token_f1`` does whole texts.
    """
    def score(p: Column, t: Column) -> Column:
        guard = (p != t) & (p.isin("yes", "no", "noanswer") | t.isin("yes", "no", "noanswer"))
        counts = F.struct(F.size(F.split(p, " ")).alias("np"), F.size(F.split(t, " ")).alias("nt"), F.size(F.array_intersect(
            _numbered(F.split(p, " ")), _numbered(F.split(t, " ")))).cast("double").alias("same"))

        def rates(c: Column) -> Column:
            none = guard | (p == "") | (t == "") | (c["same"] == 0)
            precision, recall = c["same"] / c["np"], c["same"] / c["nt"]
            zero = L(0.0)
            return F.struct(F.when(none, zero).otherwise(2 * precision * recall / (precision + recall)).alias("f1"),
                            F.when(none, zero).otherwise(precision).alias("precision"),
                            F.when(none, zero).otherwise(recall).alias("recall"))
        return let(counts, rates)
    return let2(qa_normalize(pred), qa_normalize(truth), score)


def qa_exact(pred: Column, truth: Column) -> Column:
    return qa_normalize(pred) == qa_normalize(truth)


# answers in model output

def boxed(text: Column, which: str = "last") -> Column:
    r"""Content of the first or last balanced ``\boxed{...}``.

    The text after the marker is cut at closing braces and the depth is followed over those pieces. ``first``
    gives "" without a marker and the rest of the text without a closing brace; ``last`` gives null in both.
    """
    marker = "\\boxed"
    if which == "first":
        at = F.locate(marker + "{", text)
        rest = F.substring(text, at + len(marker) + 1, F.length(text))
    else:
        at = F.locate(marker, text)
        tail = F.substring_index(text, marker, -1)
        rest = F.when(tail.startswith("{"), F.substring(tail, L(2), F.length(tail)))
    pieces = F.split(rest, r"\}", -1)
    start = F.struct(L(1).alias("depth"), L("").alias("out"))

    def step(acc, piece):
        depth = acc["depth"] + _occurrences(piece, "{") - 1
        return F.when(acc["depth"] <= 0, acc).otherwise(F.struct(
            depth.alias("depth"), F.concat(acc["out"], piece, F.when(depth > 0, L("}")).otherwise(L(""))).alias("out")))
    # every piece but the last is followed by a closing brace
    res = let(pieces, lambda p: F.aggregate(F.slice(p, L(1), F.size(p) - 1), start, step))
    if which == "first":
        return F.when(at == 0, L("")).otherwise(_trim(let(res, lambda r: F.when(r["depth"] <= 0, r["out"]).otherwise(rest))))
    return F.when(at > 0, let(res, lambda r: F.when(r["depth"] <= 0, r["out"])))


def choice_letter(text: Column, letters: str = "A-D") -> Column:
    """Letter after the last "Answer:"; short texts as they are; then "Final Answer"; then the first box."""
    main = rf"(?i)Answer\s*:\s*\$?([{letters}])[.\s\n]?"
    final = rf"(?i)Final Answer\s\n+\s*\$?([{letters}])[.\s\n]?"
    short = (F.length(text) <= 10) & ~text.contains("Answer") & ~text.contains("box")
    return F.when(short, _sub(text, r"(?U)^\s+", "")).otherwise(
        F.coalesce(_last(text, main), _first(text, final), boxed(text, "first")))


def math_normalize(c: Column) -> Column:
    r"""Ordered LaTeX clean-up for string comparison of math answers."""
    s = _sub(_trim(c), r"^\\text\{\s*([^\n]+?)\s*\}$", "$1")
    return let(s, _math_steps)


def _math_steps(keep: Column) -> Column:
    s = keep
    # fixed values: texts to replace, in order
    for old, new in [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""),
                     ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]:
        s = _rep(s, old, new)
    s = _sub(s, r"\\text\{ .*$", "")
    for old, new in [("\\%", ""), (" .", " 0."), ("{.", "{0.")]:
        s = _rep(s, old, new)
    s = _sub(s, r"^\.", "0.")
    s = _sub(s, r"^[^=]{0,2}=([^=]*)$", "$1")
    s = _sub(s, r"\\sqrt([^{])", r"\\sqrt{$1}")
    s = _rep(s, " ", "")
    s = _sub(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    s = _sub(s, r"\\frac([^{])\{", r"\\frac{$1}{")
    s = _sub(s, r"^0\.5$", r"\\frac{1}{2}")
    s = _sub(s, r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}")
    # two unit texts cannot be told apart: such answers stay as they are
    return F.when(F.size(F.split(keep, r"\\text\{ ")) > 2, keep).otherwise(s)


# fixed values: unit words dropped from numeric answers
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year",
         "foot", "feet", "inch", "yard"]
_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _commas(c: Column) -> Column:
    """Thousands commas only: a comma before exactly three digits."""
    return _sub(c, r"(?<=\d),(?=\d\d\d($|\D))", "")


def _int_text(c: Column) -> Column:
    """Whole numbers as plain integer text, null for anything else."""
    def whole(t: Column) -> Column:
        x = F.when(t.rlike(_FLOAT), t.try_cast("double"))
        return let(x, lambda v: F.when(F.abs(v - F.round(v)) <= 1e-7, F.round(v).try_cast("decimal(38,0)").cast("string")))
    return let(c, whole)


def number_normalize(c: Column) -> Column:
    """Units, currency, magnitudes, commas and mixed numbers removed or made uniform; lower case, no spaces."""
    s = _sub(c, r"^\\text\{([^\n]+)\}$", "$1")
    for old, new in [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
                     ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]:
        s = _rep(s, old, new)
    for u in UNITS:
        s = _sub(s, rf"{u}(es)?(s)? *(\^[0-9]+)?", "")
    s = _sub(s, r"\^ *\\circ", "")
    s = _sub(s, r"(?s)^\{(.*)\}$", "$1")
    s = _sub(s, r",\\! *", "")
    s = let(s, lambda x: F.coalesce(_int_text(F.trim(x)), x))
    s = _sub(s, r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", " $1/$2")
    s = _sub(s, r"\\sqrt\{([^{}]*)\}", "sqrt($1)")
    s = _sub(F.trim(s), "- *", "-")
    s = _sub(s, r"([0-9]) +([0-9])", "$1+$2")
    for ch in (" ", "{", "}"):
        s = _rep(s, ch, "")
    return let(F.lower(s), lambda x: F.coalesce(_int_text(_commas(x)), x))


def tuple_split(c: Column) -> Column:
    """Elements of a bracketed list, or the text itself as one element."""
    return let(_commas(c), lambda s: F.when(s == "", F.array().cast("array<string>")).when(
        s.rlike(r"^[()\[\]][^()\[\]]+[()\[\]]$"),
        F.transform(F.split(F.substring(s, L(2), F.length(s) - 2), ",", -1), _trim)).otherwise(F.array(s)))


_FRAC = r"^-?[0-9]+[.]?/0*[1-9][0-9]*[.]?$"


def numeric_value(c: Column) -> Column:
    """Number, fraction or mixed number (``a+b/c``) as double, else null."""
    f = r"^([+-]?\d+)/(\d+)$"
    m = r"^(-?\d+)\+(\d+)/(\d+)$"
    num = [F.regexp_extract(c, f, i).try_cast("double") for i in (1, 2)]
    mix = [F.regexp_extract(c, m, i).try_cast("double") for i in (1, 2, 3)]
    return F.when(c.rlike(_FLOAT), c.try_cast("double")).when(c.rlike(f), F.try_divide(num[0], num[1])).when(
        c.rlike(m), mix[0] + F.try_divide(mix[1], mix[2]))


def numbers_equal(given: Column, truth: Column) -> Column:
    """Equality of one element: unreduced fractions and integer/non-integer pairs never match."""
    def is_int(x: Column) -> Column:
        return _int_text(_commas(x)).isNotNull()
    return F.when(given.rlike(_FRAC) & truth.rlike(_FRAC), given == truth).when(is_int(given) != is_int(truth), L(False)).otherwise(
        F.coalesce((given == truth) | (F.abs(numeric_value(given) - numeric_value(truth)) <= 1e-12), L(False)))


def math_equal(given: Column, truth: Column) -> Column:
    """String equality after clean-up, or element-wise numeric equality of tuples. Null never matches."""
    def elements(g: Column, t: Column) -> Column:
        ends = (F.substring(g, 1, 1) == F.substring(t, 1, 1)) & (F.substring(g, -1, 1) == F.substring(t, -1, 1))

        def pairwise(ge: Column, te: Column) -> Column:
            same = F.forall(F.zip_with(ge, te, lambda x, y: F.struct(x.alias("g"), y.alias("t"))),
                            lambda x: numbers_equal(x["g"], x["t"]))
            return (F.size(ge) == F.size(te)) & ((F.size(te) <= 1) | ends) & same
        return (g == t) | ((F.length(g) > 0) & let2(tuple_split(g), tuple_split(t), pairwise))
    return F.coalesce((math_normalize(given) == math_normalize(truth))
                      | let2(number_normalize(given), number_normalize(truth), elements), L(False))


def rounded_number(c: Column) -> Column:
    """First number rounded half-to-even to whole ("3.0"), or the text itself."""
    x = _first(c, r"(-?\d+(?:\.\d+)?)").try_cast("double")
    return F.coalesce(F.concat(F.bround(x, 0).cast("decimal(38,0)").cast("string"), L(".0")), c)


def last_integer(c: Column) -> Column:
    return _last(c, r"(?<![\p{L}\p{N}_])(\d+)(?![\p{L}\p{N}_])")


def tagged_span(c: Column, tag: str = "answer") -> Column:
    """Text after the last opening tag up to the next closing tag; without a tag the text itself."""
    tail = F.substring_index(c, f"<{tag}>", -1)
    return _trim(F.substring_index(tail, f"</{tag}>", 1))


def fenced_code(c: Column, marker: str = "```") -> Column:
    """Lines strictly between the last two lines that contain the marker; "" with fewer than two."""
    lines = F.split(c, "\n", -1)
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.contains(marker), i)), lambda i: i.isNotNull())

    def body(m: Column) -> Column:
        a, b = F.try_element_at(m, L(-2)), F.try_element_at(m, L(-1))
        return F.when(b - a > 1, F.array_join(F.slice(lines, a + 2, b - a - 1), "\n")).otherwise(L(""))
    return let(marks, body)


def bracket_text(c: Column, level: str = "basic") -> Column:
    r"""First ``[[x]]``, else ``$\boxed{x}$``, else ``[x]``, cleaned per level; "NULL" without any."""
    raw = F.coalesce(_first(c, r"(?s)\[\[\s*(.*?)\s*\]\]"), _first(c, r"(?s)\$\\boxed\{(.*?)\}\$"),
                     _first(c, r"(?s)\[\s*(.*?)\s*\]"))
    s = _trim(raw)
    # fixed values: characters dropped per level
    drop = {"basic": "", "clean": '"\n []', "logic": '"\n .', "math": '"\n[]$'}[level]
    for ch in drop:
        s = _rep(s, ch, "")
    if level == "math":
        s = F.substring_index(s, "=", -1)
        s = _sub(s, r"\\[()\[\]]", "")
        s = _sub(s, r"\\text\{[^\n]*?\}", "")
        s = _sub(s, r"\\(left|right|displaystyle)", "")
        return F.coalesce(_rep(s, "\\\\", "\\"), L("NULL"))
    return F.coalesce(F.concat(L("[["), s, L("]]")), L("NULL"))


def parse_grid(c: Column) -> Column:
    """Last ``[[...]]`` of integers as array<array<int>>; null unless rectangular."""
    g = F.from_json(_last(c, r"(\[\s*\[[\d\s,\[\]]*\]\s*\])"), "array<array<int>>")
    return let(g, lambda a: F.when((F.size(a) > 0) & F.forall(a, lambda r: (F.size(r) == F.size(a[0])) & (F.size(r) > 0) & F.forall(
        r, lambda x: x.isNotNull())), a))


def parse_grids(c: Column) -> Column:
    """All ``[[...]]`` grids of the text, in order."""
    found = F.regexp_extract_all(c, L(r"(\[\s*\[[\d\s,]*\](?:\s*,\s*\[[\d\s,]*\])*\s*\])"), L(1))
    return F.filter(F.transform(found, lambda s: F.from_json(s, "array<array<int>>")), lambda g: g.isNotNull())


# prompts, names and keys

def build_scorer_text(prompt: Column, answer: Column) -> Column:
    """Prompt and answer; if the text has a "Q:", only the last one and what follows."""
    whole = _trim(F.concat_ws(" ", F.coalesce(prompt, L("")), F.coalesce(answer, L(""))))
    return let(whole, lambda t: F.when(t.contains("Q:"), _trim(F.concat(L("Q:"), F.substring_index(t, "Q:", -1)))).otherwise(t))


def label_tasks(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"Answer the following ([^\n]+?) question", 1), L(""))


def canonical_model_name(c: Column) -> Column:
    """struct(name, effort, path_name): provider prefix cut, effort suffix split off, path-safe form."""
    efforts = r"^(gpt-5)-(medium|high)$"
    return F.struct(F.when(c.rlike(efforts), L("gpt-5")).otherwise(F.regexp_replace(c, r"^[^/]*/", "")).alias("name"),
                    F.nullif(F.regexp_extract(c, efforts, 2), L("")).alias("effort"), F.translate(c, "/ ", "__").alias("path_name"))


# fixed values: where a run file name's dataset part ends, in order of priority
DATASET_NAME_RULES = [
    r"^(tau2_[^_]*)", r"^(.*?-experiment)_", r"^(.*?)_anthropic_", r"^(.*?)_openai_", r"^(.*?)_google_", r"^(.*?)_qwen_",
    r"^(.*?)_claude", r"^(.*?)_gpt", r"^(.*?)_gemini", r"^(.*?)_qwen", r"^(.*?)_", r"^(.*)$",
]


def dataset_from_file_name(c: Column) -> Column:
    """Dataset part of a run file name by the first rule that matches."""
    stem = F.replace(F.substring_index(c, "/", -1), L(".json"), L(""))
    return let(stem, lambda s: F.coalesce(*[_first(s, r) for r in DATASET_NAME_RULES]))


def json_path_extract(c: Column, paths: dict[str, str]) -> Column:
    """struct of texts at paths like ``a.b[0].c``; any miss is null."""
    return F.struct(*[F.get_json_object(c, "$." + p).alias(k) for k, p in paths.items()])


def request_key(fields: Sequence[str]) -> Column:
    """sha256 of the JSON of the fields in name order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256)


def lettered_options(options: Column) -> Column:
    """``A. x\\nB. y`` from an array."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), L(". "), x)), "\n")


def lettered_map(options: Column) -> Column:
    e = F.array_sort(F.map_entries(options))
    return F.array_join(F.transform(e, lambda x: F.concat(x["key"], L(". "), x["value"])), "\n")


def pipe_table(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(L("- "), x)), "\n")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Placeholders ``{name}`` replaced by columns."""
    out = L(template)
    for k, v in values.items():
        out = F.replace(out, L("{" + k + "}"), F.coalesce(v, L("")))
    return out
