"""Personal-data spans: exact base patterns plus boosted-tree candidates, all in SQL expressions.

Base spans are the leftmost non-overlapping matches of four patterns that pass
their checks (positions come from ``split`` and ``regexp_extract_all`` of the
same pattern, whose pieces alternate).  High-recall generators then propose
further, overlapping spans; gradient-boosted trees judge them by format and
context, and a span whose calibrated score reaches its kind's threshold is
added unless it overlaps a base span of that kind.

The trees learn from candidates that no base span overlaps, since only such can
be added.  Positives are verified spans rewritten into forms the base patterns
do not know (obfuscated, prefix-less, otherwise divided or shorter); negatives
are decoys made of the same spans and candidates that their format or context
proves to be something else (numbers, versions, dates, ids).  Other candidates
have no label.  The trees are then written out as one SQL expression, so the
whole corpus is processed by JVM expressions in a single map stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_sample, materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: texts, candidates of a kind, and verified spans of a kind that are rewritten.
TRAIN_TEXTS, TRAIN_SPANS, TRAIN_SOURCES = 1_500, 4_000, 400
#: Made-up spans of each kind that training always has, whatever the corpus holds.
SEEDS = 40
ROUNDS, DEPTH, RATE, PRECISION, CUTS = 24, 3, 0.3, 0.98, 16

_LOCAL = "A-Za-z0-9._%+-"
#: Possessive forms of the contract's patterns: same matches, no backtracking and no recursion on long runs.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be personal data of a kind: wider than the base patterns.
GENERATORS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+(?:\x20?(?:\(at\)|\[at\]|@)\x20?)[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\[\.\]|,)[0-9]{1,4}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,14}+(?![0-9A-Za-z])",
}
FEATURES = ("chars", "digits", "groups", "dots", "dashes", "spaces", "parens", "small_parts", "luhn", "at_sign", "named", "word_tail", "sentence", "before_word", "after_word", "cue_contact", "cue_secret")


def _is(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(cast(nullif(ltrim('0', p), '') as int), 0) <= 255)",
        "card": f"length({digits}) between 16 and 19 and {_luhn(digits)}",
        "phone": f"length({digits}) between 8 and 15",
    }[kind]


def _luhn(digits: str) -> str:
    d = f"cast(substr(reverse({digits}), i, 1) as int)"
    return f"(length({digits}) > 0 and aggregate(sequence(1, greatest(length({digits}), 1)), 0, (a, i) -> a + if(i % 2 = 0, 2 * {d} - if({d} > 4, 9, 0), {d})) % 10 = 0)"


_SPANS = "array<struct<s:int,e:int,m:string,pre:string,post:string>>"
_POWERS = "array(" + ", ".join(str(1 << k) for k in range(28)) + ")"


def _running(a: str, n: str, pad: int, op: str) -> str:
    """Running ``op`` of x and y (sum, max, min) over an array of n ints; passes grow with the logarithm of n."""
    return f"aggregate(filter({_POWERS}, d -> d < {n}), {a}, (acc, d) -> zip_with(acc, concat(array_repeat({pad}, d), slice(acc, 1, size(acc) - d)), (x, y) -> {op}))"


def _held(df: DataFrame, *values: Column) -> DataFrame:
    """Columns computed once a row: a generator keeps later lambdas from repeating them."""
    return df.select(F.explode(F.array(F.struct(*values))).alias("_r")).select("_r.*")


def _scan(df: DataFrame, patterns: dict[str, str], needs: str) -> DataFrame:
    """Adds a column ``_<kind>`` with all matches of a kind's pattern, as array<struct<s, e, m, pre, post>>.

    Positions are code points, end exclusive; pre and post are what stands
    around, back to the start of the match before at most.  Texts without
    ``needs`` are not scanned.  Work grows as n log n with the matches.
    """
    keep, some, text = [F.col(c) for c in df.columns], F.col("_text").rlike(needs), F.col("_text")

    def part(piece: Column, match: Column) -> Column:
        return F.struct(F.length(piece).alias("x"), match.alias("m"), F.right(piece, F.lit(24)).alias("r"), F.left(piece, F.lit(8)).alias("l"))

    none = F.array().cast("array<struct<x:int,m:string,r:string,l:string>>")
    parts = _held(df, *keep, *[F.when(some, F.zip_with(F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0)), part)).otherwise(none).alias(f"_z_{k}") for k, p in patterns.items()])
    held = [F.col(f"_z_{k}") for k in patterns]
    step = "transform(_z_@, (z, i) -> z.x + if(i = 0, 0, length(_z_@[i - 1].m)))"
    starts = _held(parts, *keep, *held, *[F.expr(f"if(size(_z_{k}) <= 1, array(), {_running(step.replace('@', k), f'size(_z_{k})', 0, 'x + y')})").cast("array<int>").alias(f"_s_{k}") for k in patterns])
    span = "transform(slice(_z_@, 1, greatest(size(_z_@) - 1, 0)), (z, i) -> struct(_s_@[i] as s, _s_@[i] + length(z.m) as e, z.m as m, right(concat(if(i = 0, '', _z_@[i - 1].m), z.r), 24) as pre, _z_@[i + 1].l as post))"
    return _held(starts, *keep, *[F.expr(span.replace("@", k)).cast(_SPANS).alias(f"_{k}") for k in patterns])


def _base(df: DataFrame) -> DataFrame:
    """Adds a column per kind with its base spans."""
    raw = _scan(df, BASE, "[0-9@]")
    return raw.select(*df.columns, *[F.expr(f"filter(_{k}, x -> {_is(k, 'x.m')})").alias(k) for k in KINDS])


def _candidates(df: DataFrame) -> DataFrame:
    """Adds ``cands``: array<struct<kind, s, e, m, pre, post>> of candidates that no base span of their kind overlaps.

    Base spans and candidates are sorted together; a candidate is overlapped if
    the farthest end of base spans before it, or the next base start, lies within it.
    """
    raw = _scan(df, GENERATORS, r"[0-9@]|[(\[]at[)\]]")
    keep, found = [F.col(c) for c in df.columns], [F.col(f"_{k}") for k in KINDS]
    both = "if(size(@) = 0 or size(_@) = 0, array(), array_sort(concat(transform(@, b -> struct(b.s as s, 0 as t, b.e as e, -1 as i)), transform(_@, (c, i) -> struct(c.s as s, 1 as t, c.e as e, i as i)))))"
    merged = _held(raw, *keep, *found, *[F.expr(both.replace("@", k)).cast("array<struct<s:int,t:int,e:int,i:int>>").alias(f"_z_{k}") for k in KINDS])
    ends, nexts = "transform(_z_@, z -> if(z.t = 0, z.e, -1))", "reverse(transform(_z_@, z -> if(z.t = 0, z.s, 2147483647)))"
    z = [F.col(f"_z_{k}") for k in KINDS]
    near = _held(merged, *keep, *found, *z, *[F.expr(x.replace("@", k)).alias(f"_{n}_{k}") for n, x in (("e", ends), ("n", nexts)) for k in KINDS])
    runs = [F.expr(_running(f"_e_{k}", f"size(_e_{k})", -1, "greatest(x, y)")).alias(f"_e_{k}") for k in KINDS] + [F.expr(f"reverse({_running(f'_n_{k}', f'size(_n_{k})', 2147483647, 'least(x, y)')})").alias(f"_n_{k}") for k in KINDS]
    ran = _held(near, *keep, *found, *z, *runs)
    free = "if(size(_z_@) = 0, _@, transform(filter(transform(_z_@, (z, j) -> struct(z.i as i, z.t = 1 and _e_@[j] <= z.s and _n_@[j] >= z.e as ok)), z -> z.ok), z -> _@[z.i]))"
    parts = [f"transform({free.replace('@', k)}, x -> struct('{k}' as kind, x.s as s, x.e as e, x.m as m, x.pre as pre, x.post as post))" for k in KINDS]
    return _held(ran, *keep, F.expr(f"concat({', '.join(parts)})").alias("cands"))


def _features(c: str) -> str:
    """Struct of numeric features of candidate ``c`` (format and context; never the base verdict)."""
    digits = f"regexp_replace({c}.m, '[^0-9]', '')"
    count = lambda what: f"(length({c}.m) - length(regexp_replace({c}.m, '{what}', '')))"
    values = {
        "chars": f"length({c}.m)",
        "digits": f"length({digits})",
        "groups": f"size(regexp_extract_all({c}.m, '[0-9]+', 0))",
        "dots": count("[.]"),
        "dashes": count("[-]"),
        "spaces": count("[ ]"),
        "parens": count("[()]"),
        "small_parts": f"cast(forall(regexp_extract_all({c}.m, '[0-9]+', 0), p -> length(p) <= 9 and cast(p as int) <= 255) as int)",
        "luhn": f"cast({_luhn(digits)} as int)",
        "at_sign": count("[@]"),
        "named": f"cast({c}.m rlike '[A-Za-z]' as int)",
        "word_tail": f"cast({c}.m rlike '[A-Za-z]{{2,}}$' as int)",
        "sentence": f"cast({c}.m rlike '[.][ ][A-Z]' as int)",
        "before_word": f"cast({c}.pre rlike '[0-9A-Za-z@._-]$' as int)",
        "after_word": f"cast({c}.post rlike '^[0-9A-Za-z@_-]' as int)",
        "cue_contact": f"cast(lower({c}.pre) rlike '(phone|tel|fon|call|mobile|cell|fax|mail|contact|card|visa|ip|host|addr)' as int)",
        "cue_secret": f"cast(lower({c}.pre) rlike '(token|key|sha|hash|version|isbn|id|=|\")' as int)",
    }
    return "struct(" + ", ".join(f"cast({values[f]} as double) as {f}" for f in FEATURES) + ")"


def _rewritten(kind: str) -> list[tuple[int, str, str]]:
    """(label, text before, span) of what training makes of a verified span ``x``."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    local, host = "substring_index(x.m, '@', 1)", "substring_index(x.m, '@', -1)"
    late = lambda m, dot: f"regexp_replace({m}, '[.](?=[^.]*$)', '{dot}')"
    valid = lambda n: f"element_at(filter(transform(sequence(0, 9), z -> concat(substr({digits}, 1, {n - 1}), z)), y -> {_luhn('y')}), 1)"
    broken = lambda m: f"concat(left({m}, length({m}) - 1), pmod(cast(right({m}, 1) as int) + 1, 10))"
    by = lambda m, n, mark: f"regexp_replace({m}, '(.{{{n}}})(?=.)', '$1{mark}')"
    if kind == "email":
        real = [late("replace(x.m, '@', ' (at) ')", " (dot) "), late("replace(x.m, '@', ' [at] ')", " [dot] "), "replace(x.m, '@', ' @ ')", "replace(x.m, '@', ' (at) ')"]
        return [*[(1, "x.pre", m) for m in real], (0, "x.pre", f"concat({local}, ' @ ', substring_index({host}, '.', 1), '. ', initcap(substring_index({host}, '.', -1)))"), (0, "x.pre", f"concat({local}, ' @ ', length(x.m), '.', 10 + length(x.pre))")]
    if kind == "ip":
        hidden = "replace(x.m, '.', '[.]')"
        return [(1, "x.pre", hidden), (0, "x.pre", "replace(x.m, '.', ',')"), (0, "x.pre", f"concat(regexp_replace({hidden}, '[0-9]+$', ''), 256 + pmod(xxhash64(x.m), 700))")]
    if kind == "card":
        real = [by(digits, 4, "."), by(digits, 4, "/"), valid(15), by(valid(13), 4, "-"), by(valid(14), 4, ".")]
        return [*[(1, "x.pre", m) for m in real], *[(0, "x.pre", broken(m)) for m in real], (0, "concat(x.pre, ' item id=')", valid(15)), (0, "x.pre", f"regexp_replace({valid(16)}, '^(.{{3}})(.{{4}})(.{{3}})(.{{3}})(.{{2}})(.*)$', '$1-$2 $3.$4.$5.$6')")]
    real = ["regexp_replace(x.m, '^[+]', '')", "regexp_replace(x.m, '^[+][0-9]{1,3}[ .-]+', '')"]
    day = "date_format(date_add(date'2000-01-01', cast(pmod(xxhash64(x.m), 9000) as int)), 'yyyy-MM-dd')"
    return [*[(1, "x.pre", m) for m in real], (0, "x.pre", day), (0, "concat(x.pre, ' item id=')", digits), (0, "concat(x.pre, ' version ')", by(digits, 2, ".")), (0, "x.pre", f"concat('555-', right({digits}, 4), ' ', 100 + pmod(xxhash64(x.m), 120), '.', substr({digits}, 2, 2), '.', substr({digits}, 3, 2))")]


#: Text before a candidate that makes it an id.
_ID_BEFORE = "(token|key|sha|hash|version|isbn|(^|[^a-z])id|=)[ :=#\"]*$"


def _other(kind: str, c: str, f: str) -> str:
    """Condition under which a candidate without base span is surely no personal data of its kind."""
    named = f"lower({c}.pre) rlike '{_ID_BEFORE}'"
    return {
        "email": f"{c}.m rlike '@[ ]?[A-Za-z0-9-]+[.][ ][A-Z]' or not {c}.m rlike '[A-Za-z]{{2,}}$'",
        "ip": f"{f}.small_parts = 0 or {c}.m rlike ','",
        "card": f"{f}.luhn = 0 or {named}",
        "phone": f"{named} or {f}.before_word = 1 or ({f}.cue_contact = 0 and {c}.m rlike '^[0-9]+$') or {c}.m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}})+$|^(19|20)[0-9]{{2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}'",
    }[kind]


@dataclass
class Trees:
    """Boosted trees of one kind: nested (feature, cut, low, high) tuples with leaf numbers, and the log-odds threshold."""

    start: float
    trees: list
    threshold: float

    def sql(self, f: str) -> str:
        def node(t) -> str:
            return repr(float(t)) + "D" if not isinstance(t, tuple) else f"case when {f}.{FEATURES[t[0]]} <= {float(t[1])!r}D then {node(t[2])} else {node(t[3])} end"

        return " + ".join([f"{self.start!r}D", *(f"({node(t)})" for t in self.trees)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        def node(t, at: np.ndarray) -> None:
            if isinstance(t, tuple):
                low = x[at, t[0]] <= t[1]
                node(t[2], at[low])
                node(t[3], at[~low])
            else:
                total[at] += t

        total = np.full(len(x), self.start)
        for t in self.trees:
            node(t, np.arange(len(x)))
        return total


def _binned(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes of a feature matrix and the cut points behind them: at most CUTS values a feature, evenly taken."""
    codes, cuts = np.zeros(x.shape, np.int64), []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])[:-1]
        cuts.append(values[:: -(-len(values) // CUTS)] if len(values) else values)
        codes[:, f] = np.searchsorted(cuts[-1], x[:, f], side="left")
    return codes, cuts


def _tree(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int):
    """Second-order regression tree over histograms of codes; leaves are shrunken Newton steps."""
    gs, hs = g[at].sum(), h[at].sum()
    leaf = float(RATE * gs / (hs + 1.0))
    if depth == 0 or len(at) < 8:
        return leaf
    best = (1e-3, None)
    for f, c in enumerate(cuts):
        if len(c):
            gl = np.cumsum(np.bincount(codes[at, f], g[at], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[at, f], h[at], len(c) + 1))[:-1]
            gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), (f, k))
    if best[1] is None:
        return leaf
    f, k = best[1]
    low = codes[at, f] <= k
    return (f, float(cuts[f][k]), _tree(codes, cuts, g, h, at[low], depth - 1), _tree(codes, cuts, g, h, at[~low], depth - 1))


def _boosted(x: np.ndarray, y: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], at: np.ndarray) -> Trees:
    """Logistic gradient boosting on the rows ``at``."""
    share = min(max(y[at].mean(), 0.5 / len(at)), 1 - 0.5 / len(at))
    model = Trees(float(np.log(share / (1 - share))), [], math.inf)
    total = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        tree = _tree(codes, cuts, y - p, np.maximum(p * (1 - p), 1e-6), at, DEPTH)
        model.trees.append(tree)
        total += Trees(0.0, [tree], 0.0).scores(x)
    return model


def fit_trees(rows: list[list[float]], labels: list[int]) -> Trees:
    """Boosted trees on all rows, with a threshold from four-fold cross-validation.

    Each fold is scored by trees of the other three; the threshold is the lowest
    pooled score of at least even odds from which on precision is PRECISION.
    Rows of one class only give no trees and add nothing.
    """
    x, y = np.array(rows, float).reshape(len(rows), len(FEATURES)), np.array(labels, float)
    if len(set(labels)) < 2:
        return Trees(0.0, [], math.inf)
    codes, cuts = _binned(x)
    fold, pooled = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        pooled[fold == k] = _boosted(x, y, codes, cuts, np.flatnonzero(fold != k)).scores(x[fold == k])
    model = _boosted(x, y, codes, cuts, np.arange(len(y)))
    for score in np.unique(pooled[pooled >= 0]):
        if y[pooled >= score].mean() >= PRECISION:
            model.threshold = float(score)
            break
    return model


def _seeds(kind: str) -> str:
    """The n-th span of a kind that training always has, so that a kind which a corpus lacks keeps its trees."""
    number = "lpad(cast(pmod(xxhash64(id), 100000000000000) as string), 14, '0')"
    return {
        "email": "concat('user.', id, '@host', pmod(xxhash64(id), 97), '.example.org')",
        "ip": "concat_ws('.', pmod(xxhash64(id), 223) + 1, pmod(xxhash64(id, 1), 256), pmod(xxhash64(id, 2), 256), id)",
        "card": f"element_at(filter(transform(sequence(0, 9), z -> concat(4 + pmod(id, 2), {number}, z)), y -> {_luhn('y')}), 1)",
        "phone": "concat('+', pmod(id, 90) + 1, if(id % 2 = 0, ' (', ' '), 200 + pmod(xxhash64(id), 700), if(id % 2 = 0, ') 555-', '-555-'), 1000 + pmod(xxhash64(id, 1), 9000))",
    }[kind]


def _training_rows(sample: DataFrame) -> DataFrame:
    """(kind, label, made, f, o) of labelled candidates without base span; made: from a verified span; o orders them."""
    based = _base(sample)
    spans = [f"transform({k}, x -> struct('{k}' as kind, x.m as m, x.pre as pre, x.post as post))" for k in KINDS]
    spans = materialise(based.select(F.explode(F.expr(f"concat({', '.join(spans)})")).alias("x")).filter("length(x.m) <= 100").distinct(), "pii-verified")
    made = None
    for kind in KINDS:
        forms = ", ".join(f"struct({label} as label, {pre} as pre, {m} as m)" for label, pre, m in _rewritten(kind))
        some = spans.filter(F.col("x.kind") == kind).orderBy(F.xxhash64("x.m", "x.pre"), "x").limit(TRAIN_SOURCES)
        seeds = sample.sparkSession.range(SEEDS).select(F.expr(f"struct('{kind}' as kind, {_seeds(kind)} as m, ' text with a ' as pre, ' in it ' as post)").alias("x"))
        rows = some.unionByName(seeds).select("x", F.explode(F.expr(f"array({forms})")).alias("w")).filter("w.m is not null")
        rows = rows.select(F.col("x.kind").alias("_kind"), F.col("w.label").alias("_label"), F.length("w.pre").alias("_s"), F.length(F.concat("w.pre", "w.m")).alias("_e"), F.concat("w.pre", "w.m", "x.post").alias("_text"))
        made = rows if made is None else made.unionByName(rows)
    made = materialise(made, "pii-rewritten")
    made = _candidates(_base(made)).select("_kind", "_label", "_s", "_e", F.explode("cands").alias("c")).filter("c.kind = _kind and c.s = _s and c.e = _e")
    made = made.select("c.kind", F.col("_label").alias("label"), F.lit(True).alias("made"), F.expr(_features("c")).alias("f"), F.expr("xxhash64(c.m, c.pre)").alias("o"))
    found = _candidates(based).select(F.explode("cands").alias("c")).select("c", F.expr(_features("c")).alias("f"))
    other = " ".join(f"when c.kind = '{k}' then {_other(k, 'c', 'f')}" for k in KINDS)
    found = found.filter(F.expr(f"case {other} end")).select("c.kind", F.lit(0).alias("label"), F.lit(False).alias("made"), "f", F.expr("xxhash64(c.m, c.pre)").alias("o"))
    return made.unionByName(found)


def train_trees(docs: DataFrame, text_col: str = "text") -> dict[str, Trees]:
    """Fit a model per kind on labelled candidates of at most TRAIN_TEXTS distinct texts, at most TRAIN_SPANS of each kind.

    All that are made of verified spans take part; found ones fill up the rest.
    """
    text = text_or_empty(text_col)
    sample = distinct_sample(docs.select(text.alias("_text")).filter(F.col("_text").rlike("[0-9@]")), "_text", TRAIN_TEXTS)
    sample = materialise(sample, "pii-sample")
    cands = materialise(_training_rows(sample), "pii-candidates")
    out = {}
    for kind in KINDS:
        rows = cands.filter(F.col("kind") == kind).orderBy(F.desc("made"), "o").limit(TRAIN_SPANS).select("label", "f", "o").collect()
        rows.sort(key=lambda r: (r["o"], r["label"], r["f"]))  # neither folds nor sums depend on how rows arrive
        out[kind] = fit_trees([[float(x) for x in r["f"]] for r in rows], [r["label"] for r in rows])
    return out


def find_personal_data(docs: DataFrame, models: dict[str, Trees] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, the text, a column of base spans and one of added spans per kind.

    Null text counts as empty and has no spans; so has an empty table no rows.
    Null and repeated ids are rows like any others; further columns are
    ignored.  Spans are array<struct<s, e, m>>, sorted by start.
    """
    models = train_trees(docs, text_col) if models is None else models
    base = _base(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text")))
    open_kinds = [k for k in KINDS if models[k].threshold < math.inf]
    added = "array()"
    df = base
    if open_kinds:
        cands = _candidates(base)
        keep = [F.col("doc_id"), F.col("_text"), *[F.col(k) for k in KINDS]]
        judged = _held(cands, *keep, F.expr(f"transform(cands, c -> struct(c.kind as kind, c.s as s, c.e as e, c.m as m, {_features('c')} as f))").alias("feats"))
        rule = " ".join(f"when x.kind = '{k}' then {models[k].sql('x.f')} >= {models[k].threshold!r}D" for k in open_kinds)
        df = _held(judged, *keep, F.expr(f"filter(feats, x -> case {rule} else false end)").alias("feats"))
        added = "transform(filter(feats, x -> x.kind = '@'), x -> struct(x.s as s, x.e as e, x.m as m))"
    plain = [F.expr(f"transform({k}, x -> struct(x.s as s, x.e as e, x.m as m))").alias(k) for k in KINDS]
    return df.select("doc_id", F.col("_text").alias("text"), *plain, *[F.expr(added.replace("@", k)).cast("array<struct<s:int,e:int,m:string>>").alias(f"{k}_added") for k in KINDS])


def redact(found: DataFrame) -> DataFrame:
    """doc_id and the text with base and added spans replaced by ``[kind]`` (later kinds never cut into earlier spans)."""
    spans = ", ".join(f"transform(concat({k}, {k}_added), x -> struct(x.s as s, x.e as e, '{k}' as k))" for k in KINDS)
    ordered = found.withColumn("_all", F.expr(f"array_sort(concat({spans}))"))
    pieces = "aggregate(_all, struct(0 as pos, '' as out), (a, x) -> if(x.s < a.pos, a, struct(x.e as pos, concat(a.out, substr(text, a.pos + 1, x.s - a.pos), '[', x.k, ']') as out)), a -> concat(a.out, substr(text, a.pos + 1)))"
    return ordered.select("doc_id", F.expr(pieces).alias("text"))


def _texts(kind: str, parts: list[str]) -> str:
    return f"transform(array_sort({parts[0] if len(parts) == 1 else f'concat({parts[0]}, {parts[1]})'}), x -> concat('{kind}:', x.s, ':', x.e))"


def span_report(found: DataFrame) -> DataFrame:
    """The contract's digest columns: base counts, base_sha256 and all spans."""
    joined: Callable[[bool], str] = lambda more: f"array_join(concat({', '.join(_texts(k, [k, f'{k}_added'] if more else [k]) for k in KINDS)}), ',')"
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.expr(joined(False)), 256).alias("base_sha256"), F.expr(joined(True)).alias("spans"))
