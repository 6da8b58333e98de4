"""URL rules through a cascade of Bloom filters (built-in functions only).

Level 1 encodes the listed keys, level 2 the corpus keys that pass level 1 wrongly, level 3 the listed keys that
level 2 catches, and so on until no error is left. Over the corpus's whole key universe the cascade is then
exact, and judging a row needs no join: the filters' words are literals of bounded size.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.expr("substring(__u, locate('://', __u) + 3)")
    return F.when(F.expr("locate('://', __u) > 0"), F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.expr("substring(__u, locate('://', __u) + 3)")
    return F.when(F.expr("locate('://', __u) > 0"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every rule that could fit, longest first: host suffixes of the given label counts times path prefixes of the given lengths."""
    parts = F.split(host, r"\.", -1)
    keys = [
        F.when(
            (F.size(parts) >= n) & (F.length(path) >= k),
            F.struct(
                F.lit(k).__add__(F.length(F.array_join(F.slice(parts, -n, n), "."))).alias("size"),
                F.lit(n).alias("labels"),
                F.concat(F.array_join(F.slice(parts, -n, n), "."), F.substring(path, 1, k)).alias("key"),
            ),
        )
        for n in labels
        for k in lengths
    ]
    ordered = F.sort_array(F.filter(F.array(*keys), lambda x: x.isNotNull()), asc=False)
    return F.transform(ordered, lambda x: x["key"])


def _position(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 1000 + probe)), F.lit(bits))


def _build(keys: DataFrame, level: int, bits: int, probes: int) -> list[int]:
    """The filter's words: one or-aggregation, at most bits / 64 rows."""
    spots = keys.select(F.explode(F.array(*[_position(F.col("key"), level, p, bits) for p in range(probes)])).alias("p"))
    words = spots.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    out = [0] * (-(-bits // 64))
    for row in words.collect():
        out[row["w"]] = row["bits"]
    return out


def _contains(key: Column, level: int, bits: int, probes: int, words: list[int]) -> Column:
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")  # folded to one literal
    hit = F.lit(True)
    for p in range(probes):
        spot = _position(key, level, p, bits)
        word = F.get(table, F.floor(spot / 64).cast("int"))
        hit = hit & (F.getbit(word, (spot % 64).cast("int")) == 1)
    return hit


def bloom_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 40):
    """A function of a key column that tells membership in ``listed`` exactly, for every key of ``universe``.

    Both frames have a column ``key`` of distinct strings. Level 1 holds about log2(universe / listed) bits a listed
    key, later levels two or three, so that size follows the list, which the caller holds, and only the logarithm of the corpus. Keys that
    ``max_levels`` levels do not tell apart (hardly more than those of equal hashes) are compared themselves.
    """
    inside = listed.select("key")
    n_in, n_all = inside.count(), universe.count()
    if n_in == 0:
        return lambda key: F.lit(False)
    levels, now, others = [], (inside, n_in), (universe, n_all)
    while now[1] and len(levels) < max_levels:
        rate = 0.5 if levels else min(0.5, max(1e-9, now[1] / max(1, others[1])))
        probes = max(1, round(-math.log2(rate)))
        bits = 64 * max(1, math.ceil(now[1] * probes / math.log(2) / 64))
        level = len(levels)
        words = _build(now[0], level, bits, probes)
        levels.append((bits, probes, words))
        wrong = others[0].filter(_contains(F.col("key"), level, bits, probes, words))
        if not level:  # of the corpus only the few keys that pass meet the list
            wrong = wrong.join(inside, "key", "left_anti")
        wrong = cut(wrong, "cascade")
        now, others = (wrong, wrong.count()), now
    rest = [row["key"] for row in now[0].collect()] if now[1] else []

    def member(key: Column) -> Column:
        found = F.lit(len(levels) % 2 == 1)
        if rest:
            found = F.when(key.isin(rest), F.lit(len(levels) % 2 == 0)).otherwise(found)
        for level in reversed(range(len(levels))):
            bits, probes, words = levels[level]
            found = F.when(_contains(key, level, bits, probes, words), found).otherwise(F.lit(level % 2 == 1))
        return found

    return member


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(action, rule) pairs as a frame ``action, key``; later repeats of a rule lose."""
    seen: dict[str, str] = {}
    for action, rule in rules:
        seen.setdefault(rule, action)
    return spark.createDataFrame([(a, k) for k, a in seen.items()], "action string, key string")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``.

    ``rules`` are (``allow`` or ``block``, ``host/path``) pairs. A rule fits its host and all subdomains where the
    path starts with the rule's path; the longest fitting rule (host plus path, then more host labels) decides, and a
    url that no list holds gets ``default``. Null urls and urls without ``://`` have an empty host and path, which
    no rule fits. Repeated rows are each judged; other columns are ignored; no rules or no pages are fine. Two cascades,
    one for each action, are built over the distinct candidate keys of all pages.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__u"))
    base = base.select("id", url_host(F.col("__u")).alias("host"), url_path(F.col("__u")).alias("path"))
    split = [(r.partition("/")[0], "/" + r.partition("/")[2]) for _, r in rules]
    if not split:
        return base.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = sorted({h.count(".") + 1 for h, _ in split})
    lengths = sorted({len(p) for _, p in split})
    keyed = base.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    listed = rules_frame(spark, rules)
    member = {a: bloom_cascade(listed.filter(F.col("action") == a), universe) for a in ("allow", "block")}
    judged = F.transform(
        F.col("keys"),
        lambda k: F.struct(k.alias("key"), F.when(member["allow"](k), "allow").when(member["block"](k), "block").alias("action")),
    )
    first = F.get(F.filter(judged, lambda x: x["action"].isNotNull()), F.lit(0))
    return keyed.withColumn("best", first).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
