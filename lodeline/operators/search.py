"""Full-text search over inverted rows: strict, relaxed, phrases and exclusions, scores, folding, fusion.

Only postings of the query's terms leave a scan; everything after is one aggregation by document with a map-side part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60  # fixed value


#: Words that are not indexed.
STOP = tuple("a an and are as at be but by for from had has have if in into is it its no not of on or such that the their then there these they this to was were will with".split())
_EAST = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC]"


def stem(word: Column) -> Column:
    """A light stem of English words: plurals, -ing and -ed; other words stay as they are."""
    n = F.length(word)

    def less(k: int) -> Column:
        return F.substring(word, F.lit(1), n - k)

    return (
        F.when(~word.rlike("^[a-z]+$"), word).when(word.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y"))).when(word.endswith("sses"), less(2))
        .when(word.endswith("ing") & (n > 5), less(3)).when(word.endswith("ed") & (n > 4), less(2))
        .when(word.endswith("s") & (n > 3) & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is"), less(1)).otherwise(word)
    )


def tokens(text: Column) -> Column:
    """Lexemes of a text in order: stems of its words in lower case, without stop words; writing without spaces gives its
    pairs of neighbouring characters (a single character stands alone)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"{_EAST}+|(?:(?!{_EAST})[\p{{L}}\p{{N}}])+"), F.lit(0))

    def lexemes(w: Column) -> Column:
        east = w.rlike("^" + _EAST)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(east, pairs).otherwise(F.array(stem(w)))

    kept = F.filter(words, lambda w: ~w.isin(*STOP))
    return F.flatten(F.transform(kept, lexemes))


def lexemes_of(text: str) -> list[str]:
    """The same for a search line, on the driver."""
    out = []
    for w in re.findall(r"[\u3040-\u30ff\u3400-\u9fff]+|(?:(?![\u3040-\u30ff\u3400-\u9fff])[^\W_])+", text.lower()):
        if "\u3040" <= w[0] <= "\u9fff":
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        elif w not in STOP:
            out.append(_stem(w))
    return out


def _stem(w: str) -> str:
    n = len(w)
    if not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("ies") and n > 4:
        return w[:-3] + "y"
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ing") and n > 5:
        return w[:-3]
    if w.endswith("ed") and n > 4:
        return w[:-2]
    return w[:-1] if w.endswith("s") and n > 3 and not w.endswith(("ss", "us", "is")) else w


def split_camel(text: Column) -> Column:
    """A text followed by itself with spaces where a small letter or digit meets a capital."""
    return F.concat_ws(" ", text, F.regexp_replace(text, F.lit("(?<=[a-z0-9])(?=[A-Z])"), F.lit(" ")))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, lexeme, tf): the inverted rows of all documents."""
    words = docs.select(key, F.explode(tokens(text)).alias("lexeme"))
    return words.groupBy(key, "lexeme").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class Query:
    """A parsed search line: every group must be met by one of its alternatives (a word or a phrase, as lexemes), none of
    the excluded ones may occur."""

    groups: tuple[tuple[tuple[str, ...], ...], ...] = ()
    excluded: tuple[tuple[str, ...], ...] = ()

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for g in self.groups for alternative in g for w in alternative))

    @property
    def plain(self) -> bool:
        """Whether it is a conjunction of single words."""
        return not self.excluded and all(len(g) == 1 and len(g[0]) == 1 for g in self.groups)


def parse(line: str) -> Query:
    """Words, "phrases", -exclusions and ``or`` between neighbours; any text parses to something."""
    groups: list[list[tuple[str, ...]]] = []
    excluded: list[tuple[str, ...]] = []
    joined = False
    for minus, quoted, bare in re.findall(r'(-?)"([^"]*)"|(\S+)', line[:1024]):
        if bare.lower() == "or":
            joined = bool(groups)
            continue
        out = minus == "-" or bare.startswith("-")
        lexemes = lexemes_of(quoted or bare)
        if not lexemes:
            continue
        alternatives = [tuple(lexemes)] if quoted or len(lexemes) == 1 else [(w,) for w in lexemes]
        if out:
            excluded += alternatives
        elif joined and len(alternatives) == 1:
            groups[-1].append(alternatives[0])
        else:
            groups += [[a] for a in alternatives]
        joined = False
    return Query(tuple(dict.fromkeys(map(tuple, groups))), tuple(dict.fromkeys(excluded)))


def relaxed(q: Query) -> Query:
    """The same words joined by or, if the query is a plain conjunction; others stay as they are."""
    return Query((tuple(g[0] for g in q.groups),)) if q.plain and q.groups else q


def search(docs: DataFrame, key: str, text: Column, q: Query) -> DataFrame:
    """(key, matched, score) of documents that satisfy the query: a filter and a projection, nothing is shuffled.

    The score is 0.1 for each term, damped by its count, brought into [0, 1).
    """
    if not q.terms:
        return docs.select(key, F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score")).where(F.lit(False))
    bag = docs.select(key, tokens(text).alias("bag"))
    line = F.concat(F.lit(" "), F.array_join("bag", " "), F.lit(" "))

    def has(alternative: tuple[str, ...]) -> Column:
        return F.array_contains("bag", alternative[0]) if len(alternative) == 1 else line.contains(f" {' '.join(alternative)} ")

    for group in q.groups:
        hit = has(group[0])
        for alternative in group[1:]:
            hit = hit | has(alternative)
        bag = bag.where(hit)
    for alternative in q.excluded:
        bag = bag.where(~has(alternative))
    counts = [F.size(F.array_remove("bag", w)) for w in q.terms]
    matched, r = F.lit(0), F.lit(0.0)
    for left in counts:
        n = F.size("bag") - left
        matched = matched + (n > 0).cast("int")
        r = r + F.when(n > 0, 0.1 * (1 + F.log(n.cast("double")))).otherwise(0.0)
    return bag.select(key, matched.cast("long").alias("matched"), (r / (r + 1)).alias("score"))


def strict_then_relaxed(docs: DataFrame, key: str, text: Column, q: Query, limit: int | None = None) -> DataFrame:
    """(key, matched, score, relaxed): strict hits, and behind them relaxed ones to fill up to ``limit`` (all without one).

    One scan finds both; with a limit, the strict hits keep their places and only the rest is filled.
    """
    every = search(docs, key, text, relaxed(q)).withColumn("relaxed", F.col("matched") < len(q.terms) if q.plain else F.lit(False))
    return every if limit is None else every.orderBy("relaxed", F.desc("score"), key).limit(limit)


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, rank): (key, fused, found_by)."""
    every = None
    for i, one in enumerate(lists):
        part = one.groupBy(key).agg(F.min("rank").alias("rank")).withColumn("list_no", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("fused"), F.count(F.lit(1)).alias("found_by"))


# fixed values: standing of a lifecycle, live first
STANDING = {"active": 0, "candidate": 10, "unknown": 20, "deleted": 40, "archived": 45, "superseded": 50}


def standing(lifecycle: Column) -> Column:
    table = F.create_map(*[x for k, v in STANDING.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, lifecycle), F.lit(20))


def rank_order() -> list[Column]:
    """The total order of hits (needs standing, score, auth, observed_at, kind, source_id, id)."""
    return [F.col("standing"), F.col("score").desc(), F.col("auth").desc(), F.col("observed_at").desc_nulls_last(), F.col("kind"), F.col("source_id"), F.col("id")]


def fold(hits: DataFrame, whole: str, value: str) -> DataFrame:
    """Parts credit the whole they belong to: 1 - product(1 - score) of the best hit of each part."""
    from lodeline.operators.ledger import noisy_or

    return noisy_or(hits, [whole], value)


def why_below(hits: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Adds rank and ``because``: the first sort key in which a hit differs from the one above it."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    w = W.orderBy(*keys)  # callers pass a page
    ranked = hits.withColumn("rank", F.row_number().over(w))
    reason = None
    for c, _ in order:
        differs = ~F.col(c).eqNullSafe(F.lag(c).over(w))
        reason = F.when(differs, c) if reason is None else reason.when(differs, c)
    return ranked.withColumn("because", F.when(F.col("rank") > 1, reason))


def highlight(text: Column, terms: tuple[str, ...], words: int = 20) -> Column:
    """An excerpt of at most ``words`` words around the first match, words that begin like a term marked; null without a
    match. Run it on the few rows that are shown."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pattern = r"(?i)^[^\p{L}\p{N}]*(?:" + "|".join(map(re.escape, terms)) + ")"
    first = F.array_position(F.transform(parts, lambda w: w.rlike(pattern)), True)
    start = F.greatest(F.lit(1), F.least(first - words // 4, F.size(parts) - words + 1))
    shown = F.transform(F.slice(parts, start.cast("int"), words), lambda w: F.when(w.rlike(pattern), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.when(first > 0, F.array_join(shown, " "))


def rank_equivalents(hits: DataFrame, cluster: str, value: str = "score") -> DataFrame:
    """The best hit of each cluster (null: alone) with the scores of all folded in: 1 - product(1 - score).

    Adds ``subsumed``, how many hits it stands for. Hits of one cluster meet by its key with a map-side part.
    """
    whole = F.coalesce(F.concat(F.lit("c:"), F.col(cluster)), F.concat(F.lit("i:"), F.col("id")))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value)))
    columns = [c for c in hits.columns if c != value]
    # the smallest key is the best: ascending as it stands, descending negated
    best = F.struct(F.col("standing"), (-F.col(value)).alias("s"), (-F.col("auth")).alias("a"), F.col("kind"), F.col("source_id"), F.col("id"))
    both = hits.groupBy(whole.alias("_k")).agg(
        F.min_by(F.struct(*columns), best).alias("row"), F.max(x).alias("top"), F.sum(F.when(x < 1, F.log1p(-x))).alias("logs"), (F.count(F.lit(1)) - 1).alias("subsumed")
    )
    return both.select("row.*", F.when(F.col("top") >= 1, 1.0).otherwise(1 - F.exp("logs")).alias(value), "subsumed")


def _lines_with(lines: Column, term: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.contains(term)))


def grep(docs: DataFrame, key: str, path: Column, text: Column, terms: tuple[str, ...]) -> DataFrame:
    """(key, score): three for a term in the path, and 1 + ln(1 + lines) for a term in the text."""
    total = F.lit(0.0)
    lines = F.split(F.lower(text), "\n")
    for t in terms:
        n = _lines_with(lines, t)
        total = total + F.when(F.lower(path).contains(t), 3.0).otherwise(0.0) + F.when(n > 0, 1 + F.log(1.0 + n)).otherwise(0.0)
    return docs.select(key, total.alias("score")).where(F.col("score") > 0)
