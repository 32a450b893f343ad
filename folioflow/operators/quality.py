"""Checks of source and translation pairs, and of sets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows
from folioflow.functions import text as T
from folioflow.operators import similar
from folioflow.operators.units import is_done
from folioflow.tables import settle


def _warn(code: str, when: Column, detail: Column | None = None) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")))


#: What must survive a translation, by the finding's code.
KEPT = {"numbers_changed": lambda c: T.extract(c, T.NUMBER), "units_changed": lambda c: T.extract(c, T.MEASURE), "urls_changed": T.urls, "code_changed": T.code_tokens}


def unit_warnings(source: Column, answer: Column, differ: Column, kept: dict[str, tuple[Column, Column]] | None = None) -> Column:
    """Array of struct(code, detail) of a finished pair, in a fixed order.

    A null answer gives missing_text alone, a blank one unexpected_empty
    alone; differ says whether the two languages do. kept has the tokens of
    both sides by code, where they are columns already.
    """
    kept = kept or {k: (f(source), f(answer)) for k, f in KEPT.items()}
    lost = {k: T.missing_from(a, b) for k, (a, b) in kept.items()}
    a, b = T.structure(source), T.structure(answer)
    shape = F.concat_ws(", ", *[F.when(a[k] != b[k], F.concat(F.lit(k + " "), a[k].cast("string"), F.lit(" → "), b[k].cast("string"))) for k in a])
    joined = lambda x: F.array_join(x, ", ")
    every = F.array(
        _warn("untranslated", differ & T.is_prose(source) & (T.normalize_for_match(source) == T.normalize_for_match(answer))),
        *[_warn(code, F.size(x) > 0, joined(x)) for code, x in lost.items()],
        _warn("structure_mismatch", shape != "", shape),
    )
    return (
        F.when(answer.isNull(), F.array(_warn("missing_text", F.lit(True))))
        .when((T.trim(source) != "") & (T.trim(answer) == ""), F.array(_warn("unexpected_empty", F.lit(True))))
        .otherwise(F.filter(every, lambda w: w.isNotNull()))
    )


def warnings(u: DataFrame) -> DataFrame:
    """(block_id, document_id, code, detail): findings of finished units; u has source_text, translated_text, unit_status, differ."""
    done = u.where(is_done()).select("block_id", "document_id", "source_text", "translated_text", "differ")
    sides = (("source_text", "_a"), ("translated_text", "_b"))
    # the tokens are columns of their own, so that each text is searched once for each kind
    done = done.select("*", *[f(F.col(c)).alias(f"{k}{s}") for k, f in KEPT.items() for c, s in sides])
    kept = {k: (F.col(f"{k}_a"), F.col(f"{k}_b")) for k in KEPT}
    w = done.select("block_id", "document_id", F.explode(unit_warnings(F.col("source_text"), F.col("translated_text"), F.coalesce("differ", F.lit(True)), kept)).alias("w"))
    return w.select("block_id", "document_id", "w.code", "w.detail")


def duplicate_units(u: DataFrame) -> DataFrame:
    """(block_id, project_id, document_id, key): finished units of one document whose translation stands for different sources.

    Keys are hashes of the normalised texts, so neither text is shuffled.
    """
    done = u.where(is_done() & (T.trim(F.col("translated_text")) != ""))
    k = done.select("block_id", "project_id", "document_id", F.xxhash64(T.normalize_for_match(F.col("translated_text"))).alias("key"), F.xxhash64(T.normalize_for_match(F.col("source_text"))).alias("source_key"))
    many = k.groupBy("document_id", "key").agg(F.countDistinct("source_key").alias("n")).where("n >= 2")
    return k.join(many, ["document_id", "key"], "left_semi")


def glossary_findings(u: DataFrame, rules: DataFrame) -> DataFrame:
    """(block_id, term, detail): glossary rules broken by finished units of the same project.

    rules: project_id, source_term, preferred, forbidden; repeated rules count
    once. A join on project_id; a project with many units is split at runtime.
    """
    n = lambda c: T.normalize_for_match(F.coalesce(c, F.lit("")))
    r = rules.where("source_term IS NOT NULL").select("project_id", "source_term", "preferred", "forbidden", n(F.col("source_term")).alias("t"), n(F.col("preferred")).alias("p"), n(F.col("forbidden")).alias("f")).distinct()
    d = u.where(is_done() & F.col("translated_text").isNotNull()).select("block_id", "project_id", n(F.col("source_text")).alias("s"), n(F.col("translated_text")).alias("a"))
    x = d.join(r, "project_id")
    has = lambda hay, needle: (needle != "") & hay.contains(needle)
    s, a, t, p, f = (F.col(k) for k in "satpf")
    detail = F.when(has(a, f), F.concat(F.lit("forbidden: "), F.col("forbidden"))).when(has(s, t) & ~has(a, p) & ~has(a, t), F.concat(F.lit("missing: "), F.col("preferred")))
    return x.select("block_id", F.col("source_term").alias("term"), detail.alias("detail")).where("detail IS NOT NULL")


def features(texts: DataFrame, name: str, bigrams: bool = True) -> DataFrame:
    """(_id, project_id, target, name: struct(same, words, pairs)): multisets of words and bigrams as sets of numbered hashes.

    With each occurrence numbered, set intersection is multiset intersection.
    """

    def make():
        from collections import Counter

        import xxhash

        def numbered(items):
            seen: Counter = Counter()
            out = []
            for x in items:
                seen[x] += 1
                out.append(xxhash.xxh64_intdigest(f"{x}\x00{seen[x]}") - (1 << 63))
            return out

        def kernel(ids, projects, targets, texts):
            made = [{"same": xxhash.xxh64_intdigest(t) - (1 << 63), "words": numbered(t.split()), "pairs": numbered([t[i : i + 2] for i in range(max(1, len(t) - 1))]) if bigrams else []} for t in texts]
            return [ids, projects, targets, made]

        return kernel

    return map_rows(texts.select("_id", "project_id", "target", "t"), f"_id string, project_id string, target string, {name} struct<same: bigint, words: array<bigint>, pairs: array<bigint>>", make)


def similar_units(queries: DataFrame, memory: DataFrame, least: float = 0.6, k: int | None = 3) -> DataFrame:
    """(query_id, match_id, score, rank): the most similar finished units of the same project and target.

    Both have id, project_id, target, text; queries and memory may overlap.
    A score of at least ``least`` needs word Dice of at least d = 2·least − 1.
    Two word sets with that Dice share a word among the rarest
    n − ceil(n·d/(2 − d)) + 1 of each, so only those prefixes are joined: no
    match is lost and frequent words make no pairs. Equal texts join by
    their hash. ``least`` must exceed one half. Texts and words are settled
    (actions).
    """
    if least <= 0.5:
        raise ValueError("a bound of one half or less has no common word to join on")
    d = 2 * least - 1
    from pyspark.sql import Window

    def side(df: DataFrame, name: str) -> DataFrame:
        t = df.select(F.col("id").alias(name), "project_id", "target", T.normalize_for_match(F.col("text")).alias("t")).where("t <> ''")
        return t

    # the normalised texts are read three times, so they are worked out once
    q, m = settle(side(queries, "query_id")), settle(side(memory, "match_id"))

    def made(df: DataFrame, key: str, name: str, bigrams: bool) -> DataFrame:
        return features(df.withColumnRenamed(key, "_id"), name, bigrams).withColumnRenamed("_id", key)

    qa, mb = made(q, "query_id", "a", False), settle(made(m, "match_id", "b", False))
    gq = qa.select("query_id", "project_id", "target", F.size("a.words").alias("n"), F.explode("a.words").alias("g"))
    gm = mb.select("match_id", "project_id", "target", F.size("b.words").alias("n"), F.explode("b.words").alias("g"))
    rarity = gm.groupBy("g").agg(F.count("*").alias("f"))

    def prefix(g: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(name, "project_id", "target").orderBy(F.coalesce("f", F.lit(0)), "g")
        r = g.join(rarity, "g", "left").withColumn("r", F.row_number().over(w))
        return r.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(d / (2 - d)) - F.lit(1e-9)) + 1).select(name, "project_id", "target", "g", "n")

    a, b = prefix(gq, "query_id"), prefix(gm, "match_id").withColumnRenamed("n", "n2")
    pairs = a.join(b, ["project_id", "target", "g"]).where((F.lit(2.0) * F.least("n", "n2") / (F.col("n") + F.col("n2")) >= d) & (F.col("query_id") != F.col("match_id"))).select("query_id", "match_id", "project_id", "target").distinct()
    # bigrams are worked out for texts that have a candidate only
    qa = made(q.join(pairs.select("query_id").distinct(), "query_id", "left_semi"), "query_id", "a", True)
    mb = made(m.join(pairs.select("match_id").distinct(), "match_id", "left_semi"), "match_id", "b", True)
    common = lambda k: F.lit(2.0) * F.size(F.array_intersect(f"a.{k}", f"b.{k}")) / (F.size(f"a.{k}") + F.size(f"b.{k}"))
    score = F.when(F.col("a.same") == F.col("b.same"), F.lit(1.0)).otherwise(F.lit(0.5) * common("words") + F.lit(0.5) * common("pairs"))
    scored = pairs.join(qa, ["query_id", "project_id", "target"]).join(mb, ["match_id", "project_id", "target"]).select("query_id", "match_id", score.alias("score")).where(F.col("score") >= least)
    if k is None:
        return scored
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Units that ask in one task, about: a larger project is dealt to several, each of which meets its whole memory.
SLICE = 16_000


def slices(units: DataFrame) -> DataFrame:
    """(project_id, slices): projects too large for one slice. units: project_id; rows that are no units any more may count too."""
    n = units.groupBy("project_id").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    return n.where("project_id IS NOT NULL AND slices > 1")


def suggestions(queries: DataFrame, memory: DataFrame, least: float = 0.6, k: int = 3) -> DataFrame:
    """(query_id, match_id, score, rank): ``suggested`` of queries and a memory in two tables of id, project_id, target, text; they may overlap."""
    side = lambda df, asks: df.select("id", "project_id", "target", "text", F.lit(asks).alias("asks"), F.lit(not asks).alias("stored"))
    return suggested(side(queries, True).unionByName(side(memory, False)), None, least, k)


def suggested(units: DataFrame, dealt: DataFrame | None = None, least: float = 0.6, k: int = 3) -> DataFrame:
    """(query_id, match_id, score, rank): the k stored units most similar to each unit that asks, ties to the smaller id.

    units: id, project_id, target, text, asks, stored; a unit isn't suggested
    for itself. A project and target is a group; dealt has the slices of large
    projects. Each normalised text moves once to its slice, and if stored to
    the others of its group, so that neither words nor pairs are shuffled and
    no task has to hold a group. Texts that are alike are compared once a
    slice. The work grows with the pairs of a group whose lengths are near.
    Null and empty texts have no suggestion, nor have units without project or
    target. ``least`` must exceed one half.
    """
    if least <= 0.5:
        raise ValueError("a bound of one half or less has no common word to join on")
    key = ["project_id", "target", "slice"]
    t = units.where("project_id IS NOT NULL AND target IS NOT NULL AND (asks OR stored)").select("project_id", "target", "asks", "stored", T.normalize_for_match(F.col("text")).alias("t"), "id")
    t = t.select("*", F.length("t").alias("n"), F.xxhash64("t").alias("h"))
    if dealt is None:
        rows = t.withColumn("slice", F.lit(0))
    else:
        t = t.join(F.broadcast(dealt), "project_id", "left").withColumn("of", F.coalesce("slices", F.lit(1)))  # large projects only
        t = t.withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
        to = F.when(F.col("stored"), F.sequence(F.lit(0), F.col("of") - 1)).otherwise(F.array("own"))
        rows = t.withColumn("slice", F.explode(to)).withColumn("asks", F.col("asks") & (F.col("slice") == F.col("own")))
    rows = rows.repartition(*key).sortWithinPartitions(*key, F.desc("asks"), "n", "h", "id")
    return map_rows(rows.select(*key, "asks", "stored", "t", "id"), "query_id string, match_id string, score double, rank int", lambda: similar.kernel(least, k))
