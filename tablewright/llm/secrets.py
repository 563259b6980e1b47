"""Secret scans through an inverted index of trigrams, in DataFrame functions only.

From each rule's regular expression a Boolean query follows: a text can match
only if, for one of the alternatives, it holds all trigrams of the literal parts
(lower case). The index has a posting (trigram, document) for every trigram that
any rule asks for. Intersecting the postings of a document, as bits, tells which
rules it is a candidate of; only those are verified by their expressions. A rule
without mandatory trigrams (a bare run of hexadecimal digits) is verified on
every text.

Defined cases: a null text counts as empty; rows with a null or repeated key
share their postings and are each verified on their own text; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: whose length counts
    least: int = 1  #: characters of it at least


#: The kinds asked for, in their order, then common forms of keys that the method adds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: Stands for a part of a match that is not known; no trigram crosses it.
GAP = "\0"
#: A part that would make more alternatives than this counts as unknown.
MOST_ALTERNATIVES = 64


# --- Boolean trigram queries -------------------------------------------------------------------


def _alternatives(nodes) -> set[str]:
    """What the nodes of a parsed expression can match, as literal text with gaps."""
    out = {""}
    for kind, value in nodes:
        if kind is op.LITERAL:
            part = {chr(value)}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
            part = {chr(v) for _, v in value}
        elif kind is op.SUBPATTERN:
            part = _alternatives(value[3])
        elif kind is op.BRANCH:
            part = set().union(*(_alternatives(x) for x in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            one = _alternatives(inner)
            part = {""}
            for _ in range(min(low, 4)):
                part = {a + b for a, b in product(part, one)}
                if len(part) > MOST_ALTERNATIVES:
                    part = {GAP}
            if low == 0 and high == 1:
                part |= one
            elif low > 4 or high != low:
                part = {a + GAP for a in part}
        else:
            part = {GAP}
        out = {a + b for a, b in product(out, part if len(out) * len(part) <= MOST_ALTERNATIVES else {GAP})}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The alternatives of a rule, each a set of trigrams that must all be there; None if one asks for none."""
    sets = {frozenset(s[i : i + 3] for s in a.lower().split(GAP) for i in range(len(s) - 2)) for a in _alternatives(parser.parse(pattern))}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


# --- index -------------------------------------------------------------------------------------


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings (trigram, doc_id) of the given trigrams."""
    low = docs.select(F.col(key).alias("doc_id"), F.lower(c.text_of(text)).alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id and, as bits in the order of ``queries``, the rules whose query the document's postings satisfy."""
    words = sorted({t for q in queries.values() for s in q for t in s})
    place = {t: (n // 60, 1 << (n % 60)) for n, t in enumerate(words)}
    columns = range(len(words) // 60 + 1)
    bit = {k: [t for t in words if place[t][0] == k] for k in columns}
    masks = [F.bit_or(sum((F.when(F.col("trigram") == t, F.lit(place[t][1])).otherwise(F.lit(0)) for t in bit[k]), F.lit(0).cast("long"))).alias(f"m{k}") for k in columns]
    met = index.groupBy("doc_id").agg(*masks)

    def holds(trigrams: frozenset[str]) -> Column:
        need = {k: sum(place[t][1] for t in trigrams if place[t][0] == k) for k in columns}
        out = F.lit(True)
        for k, m in need.items():
            if m:
                out = out & (F.col(f"m{k}").bitwiseAND(F.lit(m)) == F.lit(m))
        return out

    rules = F.lit(0).cast("long")
    for n, q in enumerate(queries.values()):
        some = F.lit(False)
        for s in q:
            some = some | holds(s)
        rules = rules.bitwiseOR(F.when(some, F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")))
    return met.select("doc_id", rules.alias("rules")).filter("rules <> 0")


# --- verification ------------------------------------------------------------------------------


def _spans(kind: int, rule: Rule, text: str, test: Column | None) -> tuple[Column, Column]:
    """Two steps: the text cut at the matches, then the spans that pass, from the lengths of what lies between."""
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    cut = F.expr(f"split({text}, '{pattern}', -1)")
    cut = cut if test is None else F.when(test, cut)
    return cut, F.expr(
        f"""if(coalesce(size(cut{kind}), 0) < 2, cast(array() as array<struct<start:int,kind:int,end:int>>), aggregate(
            arrays_zip(slice(cut{kind}, 1, size(cut{kind}) - 1) as gap, regexp_extract_all({text}, '{pattern}', 0) as hit, regexp_extract_all({text}, '{pattern}', {rule.group}) as part),
            named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int>>)),
            (a, x) -> named_struct('at', a.at + length(x.gap) + length(x.hit), 'out', if(length(x.part) >= {rule.least},
                concat(a.out, array(named_struct('start', a.at + length(x.gap), 'kind', {kind}, 'end', a.at + length(x.gap) + length(x.hit)))), a.out)),
            a -> a.out))""".replace(" as gap", "").replace(" as hit", "").replace(" as part", "")
        .replace("x.gap", "x['0']").replace("x.hit", "x['1']").replace("x.part", "x['2']")
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: for every text all verified spans (start, kind as a number, end) in code points, in that order."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    order = list(queries)
    index = build_index(docs, sorted({t for q in queries.values() for s in q for t in s}), key, text)
    found = candidates(index, queries).withColumnRenamed("doc_id", "candidate")
    texts = c.id_texts(docs, key, text)
    joined = texts.join(found, texts["doc_id"].eqNullSafe(found["candidate"]), "left")
    both = [_spans(n, r, "text", (F.col("rules").bitwiseAND(F.lit(1 << order.index(r.kind))) != 0) if r.kind in queries else None) for n, r in enumerate(rules)]
    cut = joined.select("doc_id", "text", *[x.alias(f"cut{n}") for n, (x, _) in enumerate(both)])
    return cut.select("doc_id", F.array_sort(F.concat(*[x for _, x in both])).alias("spans"))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(c.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)],
        F.sha2(_written(base, RULES), 256).alias("base_sha256"),
        _written(F.col("spans"), RULES).alias("spans"),
    )


def sql() -> str:
    """The same for DuckDB: every rule on every text."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    cut = " union all ".join(
        f"select doc_id, {n} as k, '{r.kind}' as kind, string_split_regex(text, {quoted(r.pattern)}) as gaps, regexp_extract_all(text, {quoted(r.pattern)}, 0) as hits, "
        f"regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) as parts, {r.least} as least from t"
        for n, r in enumerate(RULES)
    )
    return f"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    cut as ({cut}),
    each as (select doc_id, k, kind, gaps, hits, parts, least, unnest(range(1, len(hits) + 1)) as i from cut where len(hits) > 0),
    span as (
        select doc_id, k, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as s, length(hits[i]) as n
        from each where length(parts[i]) >= least
    ),
    joined as (
        select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
               string_agg(kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint), ',' order by s, k) filter (k < {len(BASE)}) as base,
               string_agg(kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint), ',' order by s, k) as spans
        from span group by doc_id
    )
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from t left join joined on t.doc_id = joined.doc_id
    """
