"""Rule matching as column expressions.

Everything about one text happens inside its row: lines, matches, masks,
context and the removal of repeats.  Nothing of a text is shuffled, and raw
values end in the same expression that makes their masks.

The expressions hold one branch per rule, so they are written as Spark SQL text
and parsed in one call; building them from single column calls takes seconds.
In the text fragments below each argument is the SQL text of an expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsift.functions.filters import LINE_FILTER_PATTERNS, PLACEHOLDER_PATTERN
from credsift.functions.text import MASK_EDGE, MASK_STARS
from credsift.options import ScanOptions
from credsift.rules import DEFAULT_RULES, Rule, gate_patterns, to_java


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _apply(value: Column, name: str, body: str) -> Column:
    """``body`` with ``name`` bound to ``value``, which is computed once per row."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# -- SQL text ----------------------------------------------------------------

def _may_match(text: str, rules: Sequence[Rule]) -> str:
    framed = f"concat('\\n', {text})"
    return "(" + " OR ".join(f"rlike({framed}, {_quoted(pattern)})" for pattern in gate_patterns(rules)) + ")"


def _fold_case(line: str) -> str:
    return f"translate(lower({line}), 'ſ', 's')"


def _mask(value: str) -> str:
    edge = MASK_EDGE
    return (
        f"if(length({value}) <= {2 * edge}, repeat('*', length({value})), "
        f"concat(left({value}, {edge}), repeat('*', least(length({value}) - {2 * edge}, {MASK_STARS})), "
        f"right({value}, {edge})))"
    )


def _rule_matches(line: str, folded: str, rules: Sequence[Rule]) -> str:
    branches = []
    for rule_ord, rule in enumerate(rules):
        found = f"regexp_extract_all({line}, {_quoted(rule.java_pattern)}, {rule.group})"
        if rule.group and not rule.shipped:  # the group may take no part
            whole = f"regexp_extract_all({line}, {_quoted(rule.java_pattern)}, 0)"
            found = f"zip_with({found}, {whole}, (g, w) -> if(g = '', w, g))"
        if rule.anchors:
            anchored = " OR ".join(f"contains({folded}, {_quoted(anchor)})" for anchor in rule.anchors)
            found = f"CASE WHEN {anchored} THEN {found} END"
        branches.append(f"struct({rule_ord} AS rule_ord, {found} AS raws)")
    # Filtered before anything is taken out of it: one evaluation per pattern.
    return (
        f"flatten(transform(filter(array({', '.join(branches)}), r -> size(r.raws) > 0), "
        "r -> transform(r.raws, (raw, n) -> struct(r.rule_ord AS rule_ord, n AS match_ord, raw AS raw))))"
    )


def _secret_matches(line: str, rules: Sequence[Rule]) -> str:
    matches = _let("folded", _fold_case(line), _rule_matches(line, "folded", rules))
    return f"filter({matches}, s -> length(s.raw) > 0 AND NOT rlike(s.raw, {_quoted(to_java(PLACEHOLDER_PATTERN))}))"


# Arrays are folded, and long lines cut, in pieces of this size: work on a line
# then grows with its length, not with the square of the secrets in it.
PIECE = 256


def _running(values: str, fold: str) -> str:
    """The sums or maxima of a non-empty array up to each of its places."""
    total, join = {
        "sum": (lambda part: f"aggregate({part}, 0, (s, y) -> s + y)", lambda a, b: f"{a} + {b}"),
        "max": (lambda part: f"array_max({part})", lambda a, b: f"greatest({a}, {b})"),
    }[fold]
    parts = f"transform(sequence(0, (size(v) - 1) div {PIECE}), b -> slice(v, b * {PIECE} + 1, {PIECE}))"
    before = (
        f"aggregate(transform(parts, part -> {total('part')}), array(0), (done, x) -> "
        f"concat(done, array({join('element_at(done, -1)', 'x')})))"
    )
    within = (
        "flatten(transform(parts, (part, b) -> transform(part, (x, j) -> "
        f"{join('get(before, b)', total('slice(part, 1, j + 1)'))})))"
    )
    return _let("v", values, _let("parts", parts, _let("before", before, within)))


def _cut(start: str, length: str) -> str:
    """Characters of the line that ``pieces`` holds; only the pieces they are in are looked at."""
    first, last = f"({start}) div {PIECE}", f"({start} + {length}) div {PIECE}"
    return (
        f"substring(array_join(slice(pieces, {first} + 1, {last} - {first} + 1), ''), ({start}) % {PIECE} + 1, {length})"
    )


def _masked_line(line: str, found: str) -> str:
    """The line with every place of every value in ``found`` masked.

    Places that overlap are masked as one, so no part of a value stays because
    another value was masked first.  Places of a single value do not overlap
    and are replaced one by one; bytes that are no text are left to the long way.
    """
    value = f"get({found}, 0).raw"
    single = f"size({found}) > 0 AND is_valid_utf8({line}) AND forall({found}, f -> f.raw = {value})"
    return f"if({single}, replace({line}, {value}, {_mask(value)}), {_masked_places(line, found)})"


def _masked_places(line: str, found: str) -> str:
    """The same for any values: their places put in order, joined where they overlap, and masked."""
    literal = r"concat('\\Q', replace(v, '\\E', '\\E\\\\E\\Q'), '\\E')"
    between = f"transform(split({line}, {literal}, -1), part -> length(part))"
    # what stands before the i-th place: i + 1 parts between places, i values
    starts = _let("summed", _running("lengths", "sum"), "transform(slice(summed, 1, size(summed) - 1), (t, i) -> t + i * length(v))")
    places = f"if(size(lengths) = 1, array(), transform({starts}, s -> struct(s AS s, s + length(v) AS e)))"
    spans = (
        f"array_sort(flatten(transform(array_distinct(transform({found}, f -> f.raw)), v -> {_let('lengths', between, places)})))"
    )
    upto = _running("transform(spans, x -> x.e)", "max")
    # a span that begins behind all before it begins an island, which ends where they end
    opens = "filter(sequence(0, size(spans) - 1), j -> j = 0 OR get(upto, j - 1) <= get(spans, j).s)"
    islands = (
        "transform(opens, (j, k) -> struct(get(spans, j).s AS s, "
        "get(upto, coalesce(get(opens, k + 1), size(spans)) - 1) AS e))"
    )
    pieces = f"regexp_extract_all({line}, '(?s).{{1,{PIECE}}}', 0)"
    masked = _let("hidden", _cut("x.s", "(x.e - x.s)"), _mask("hidden"))
    kept = _let("gap", "if(k = 0, 0, get(islands, k - 1).e)", _cut("gap", "(x.s - gap)"))
    rest = _let("gap", "get(islands, size(islands) - 1).e", _cut("gap", f"(length({line}) - gap)"))
    joined = f"concat(array_join(transform(islands, (x, k) -> concat({kept}, {masked})), ''), {rest})"
    shown = _let("upto", upto, _let("opens", opens, _let("islands", islands, _let("pieces", pieces, joined))))
    return _let("spans", spans, f"if(size(spans) = 0, {line}, {shown})")


def _line_fits(line: str, max_bytes: int | None) -> str:
    return "true" if max_bytes is None else f"octet_length({line}) <= {max_bytes}"


def _text_lines(text: str) -> str:
    bytewise = (
        f"transform(split(decode(cast({text} AS binary), 'ISO-8859-1'), '\\n', -1), "
        "b -> cast(encode(b, 'ISO-8859-1') AS string))"
    )
    return f"if(is_valid_utf8({text}), split({text}, '\\n', -1), {bytewise})"


def _context_idxs(lines: str, line_idx: str) -> str:
    """Positions of the line before, the line and the line after, without invalid UTF-8."""
    around = f"sequence(greatest({line_idx} - 1, 0), least({line_idx} + 1, size({lines}) - 1))"
    return f"filter({around}, y -> is_valid_utf8(get({lines}, y)))"


def _raw_context(lines: str, line_idx: str) -> str:
    return f"array_join(transform({_context_idxs(lines, line_idx)}, y -> get({lines}, y)), '\\n')"


def _redacted_context(lines: str, shown: str, line_idx: str, options: ScanOptions) -> str:
    """``shown`` holds the lines with their secrets masked."""
    examined = f"filter({_context_idxs(lines, line_idx)}, y -> {_line_fits(f'get({lines}, y)', options.max_line_bytes)})"
    return f"array_join(transform({examined}, y -> get({shown}, y)), '\\n')"


def _line_secrets(line: str, rules: Sequence[Rule], options: ScanOptions, code_lines: bool) -> str:
    """What a line holds, NULL for a line that is too long, cannot match or is left out as code."""
    examined = f"{_line_fits(line, options.max_line_bytes)} AND {_may_match(line, rules)}"
    if not code_lines:
        examined += f" AND NOT {_looks_like_code(line, options)}"
    return f"CASE WHEN {examined} THEN {_secret_matches(line, rules)} END"


def _looks_like_code(line: str, options: ScanOptions) -> str:
    return f"rlike({line}, {_quoted(to_java(LINE_FILTER_PATTERNS[options.line_filter]))})"


def _hit_context(context: str) -> str:
    return f"CASE WHEN size(get(secrets, i)) > 0 THEN {context} END"


# The first hit of each (rule, mask), in scan order: a sort, no pairwise test.
_FIRST_PER_KEY = _let(
    "keyed",
    "array_sort(transform(hits, (h, i) -> struct(h.rule_ord AS r, h.masked AS m, i AS i)))",
    "transform(array_sort(transform("
    "filter(keyed, (k, j) -> j = 0 OR get(keyed, j - 1).r != k.r OR get(keyed, j - 1).m != k.m), "
    "k -> k.i)), i -> get(hits, i))",
)


# -- column functions --------------------------------------------------------

def may_match(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """False only if no rule can match anywhere in the text (one pass over it)."""
    framed = F.concat(F.lit("\n"), text)
    tests = [framed.rlike(pattern) for pattern in gate_patterns(rules)]
    passed = tests[0]
    for test in tests[1:]:
        passed = passed | test
    return passed


def split_text(text: Column) -> Column:
    """The lines of a text as an array: split on LF only, CR and empty lines kept.

    Text that is not valid UTF-8 is split byte by byte, so that each line keeps
    its own bytes and can be measured and tested by itself.
    """
    return _apply(text, "t", _text_lines("t"))


def rule_matches(line: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """All matches of all rules on one line, in rule order, left to right.

    ``array<struct<rule_ord, match_ord, raw>>``.
    """
    return _apply(line, "line", _let("folded", _fold_case("line"), _rule_matches("line", "folded", rules)))


def secret_matches(line: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """``rule_matches`` without empty and placeholder values."""
    return _apply(line, "line", _secret_matches("line", rules))


def line_context(lines: Column, line_idx: Column) -> Column:
    """The line before, the line and the line after, joined by LF; invalid UTF-8 left out."""
    at = F.struct(lines.alias("lines"), line_idx.alias("idx"))
    return _apply(at, "at", _raw_context("at.lines", "at.idx"))


def redact_text(
    text: Column, rules: Sequence[Rule] = DEFAULT_RULES, max_line_bytes: int | None = None
) -> Column:
    """The whole text, every matched value masked; values that overlap are masked as one.

    A value on a comment line, a repeat or a value beyond a cap is still a
    leak, so neither the line filter nor any cap applies, and long lines are
    redacted as well unless a limit is given.
    """
    secrets = _line_secrets("line", rules, ScanOptions(max_line_bytes=max_line_bytes), code_lines=True)
    redacted = _let("found", secrets, f"if(found IS NULL, line, {_masked_line('line', 'found')})")
    body = f"if({_may_match('t', rules)}, array_join(transform({_text_lines('t')}, line -> {redacted}), '\\n'), t)"
    return _apply(text, "t", body)


def content_hits(
    text: Column,
    rules: Sequence[Rule] = DEFAULT_RULES,
    options: ScanOptions = ScanOptions(),
    first_per_key: bool = True,
    own: Column | None = None,
) -> Column:
    """All hits in one text, in scan order: by line, rule, match.

    ``array<struct<line_idx, rule_ord, match_ord, masked, context, entry_hits>>``,
    ``entry_hits`` being the number of them; NULL for a text that cannot hold any.  With ``first_per_key`` only the first hit of
    each (rule, mask) is kept, so what leaves the row is bounded by the distinct
    secrets in it.  With ``own``, a struct of the first and last line ``lo, hi``
    and these lines as a text ``t``, other lines serve as context only and do not
    pass the gate.
    """
    redacted = options.context == "redacted"
    secrets = f"transform(lines, line -> {_line_secrets('line', rules, options, code_lines=redacted)})"
    # A redacted context masks what stands on code lines too; such lines give no hits.
    # a line without secrets is NULL, and NULL AND x would look at x: the line filter is for hit lines only
    on_hit_line = "coalesce(size(found), 0) > 0" + (f" AND NOT {_looks_like_code('get(lines, i)', options)}" if redacted else "")
    if own is not None:
        on_hit_line += " AND i BETWEEN at.lo AND at.hi"
    masked = (
        f"flatten(transform(secrets, (found, i) -> CASE WHEN {on_hit_line} THEN transform(found, m -> "
        f"struct(i AS line_idx, m.rule_ord AS rule_ord, m.match_ord AS match_ord, {_mask('m.raw')} AS masked)) "
        "ELSE array() END))"
    )
    kept = _let("hits", masked, _FIRST_PER_KEY) if first_per_key else masked
    # Each line is masked once and each context put together once, however many hits share it.
    shown = f"transform(lines, (line, i) -> if(size(get(secrets, i)) > 0, {_masked_line('line', 'get(secrets, i)')}, line))"
    context = {
        "redacted": _let("shown", shown, f"transform(lines, (line, i) -> {_hit_context(_redacted_context('lines', 'shown', 'i', options))})"),
        "raw": f"transform(lines, (line, i) -> {_hit_context(_raw_context('lines', 'i'))})",
        "none": "array(cast(null AS string))",
    }[options.context]
    in_context = _let(
        "kept", kept,
        _let(
            "contexts", f"if(size(kept) = 0, array(cast(null AS string)), {context})",
            "transform(kept, h -> struct(h.line_idx AS line_idx, h.rule_ord AS rule_ord, h.match_ord AS match_ord, "
            "h.masked AS masked, get(contexts, h.line_idx) AS context, size(kept) AS entry_hits))",
        ),
    )
    body = _let("lines", _text_lines("t"), _let("secrets", secrets, in_context))
    if own is None:
        return _apply(text, "t", f"CASE WHEN {_may_match('t', rules)} THEN {body} END")
    at = F.struct(text.alias("t"), own["lo"].alias("lo"), own["hi"].alias("hi"), own["t"].alias("own"))
    return _apply(at, "at", f"CASE WHEN {_may_match('at.own', rules)} THEN {_let('t', 'at.t', body)} END")
