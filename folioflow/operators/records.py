"""Record stores as tables: lookups, upserts, deletes, cascades, settings, catalog overlays, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: What settings default to when a value is missing or of another type.
SETTINGS = {"target_language": "my", "batch_concurrency": 3, "usage_tracking": True, "quality": "standard"}
#: Longest glossary fields.
GLOSSARY_LIMITS = {"source_term": 200, "preferred": 500, "forbidden": 500, "notes": 1000}


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row with one key; the predicate reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def by_index(df: DataFrame, index: str, key: str, equal=None, low=None, high=None, count: int | None = None) -> DataFrame:
    """Rows by equality or range of an indexed column, in its order; rows with a null there are in no index."""
    r = df.where(F.col(index).isNotNull())
    for test in ((equal, lambda c, v: c == v), (low, lambda c, v: c >= v), (high, lambda c, v: c <= v)):
        if test[0] is not None:
            r = r.where(test[1](F.col(index), F.lit(test[0])))
    return r.orderBy(index, key).limit(count) if count is not None else r


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of ``changes`` in place of those with the same key; the last duplicate of changes by all columns wins."""
    cols = df.columns
    last = changes.select(*cols).groupBy(key).agg(F.max(F.struct(*cols)).alias("r")).select("r.*")
    return df.join(last.select(key), key, "left_anti").select(*cols).unionByName(last)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def cascade(tables: dict[str, DataFrame], parents: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted parents."""
    return {n: delete(t, parents, key) for n, t in tables.items()}


def with_defaults(df: DataFrame, keys: DataFrame, key: str, defaults: dict) -> DataFrame:
    """A row for each key: the stored one, with defaults for missing rows and null fields."""
    j = keys.select(key).distinct().join(df, key, "left")
    return j.select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def settings(stored: DataFrame) -> DataFrame:
    """One row of typed settings from (key, value JSON); wrong types fall back to the default."""

    def pick(k, v):
        raw = F.max(F.when(F.col("key") == k, F.col("value")))
        if isinstance(v, bool):
            typed = F.when(raw.isin("true", "false"), raw == "true")
        elif isinstance(v, int):
            typed = F.when(raw.rlike(r"^-?\d{1,9}$"), raw.cast("int"))
        else:
            typed = F.when(raw.rlike(r'^".*"$'), F.regexp_replace(raw, '^"|"$', ""))
        return F.coalesce(typed, F.lit(v)).alias(k)

    return stored.agg(*[pick(k, v) for k, v in SETTINGS.items()])


def glossary_errors(rules: DataFrame) -> DataFrame:
    """(rule_id, error): missing fields, long fields, and terms that repeat in their project."""
    long = [F.when(F.length(F.trim(c)) > n, F.lit(f"{c} too long")) for c, n in GLOSSARY_LIMITS.items() if c in rules.columns]
    need = [F.when(F.coalesce(T.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} missing")) for c in ("source_term", "preferred")]
    plain = rules.select("rule_id", F.explode(F.array_compact(F.array(*need, *long))).alias("error"))
    term = T.normalize_term(F.col("source_term"))
    twice = rules.withColumn("_t", term).where("_t <> ''").groupBy("project_id", "_t").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("rule_id")).alias("ids")).where("n > 1")
    return plain.unionByName(twice.select(F.explode(F.slice("ids", F.lit(2), F.size("ids"))).alias("rule_id"), F.lit("duplicate term").alias("error")))


def overlay(catalog: DataFrame, patches: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """The catalog with each field taken from its patch where that has one."""
    p = patches.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    j = catalog.join(p, list(keys), "left")
    return j.select(*keys, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """(store, record): every row of every table as JSON, credentials redacted."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("store"), T.redact(F.to_json(F.struct(*df.columns))).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


def changes(log: DataFrame) -> DataFrame:
    """The last change of each (entity, entity_id, op): what a push still has to send, oldest first by at."""
    return log.groupBy("entity", "entity_id", "op").agg(F.max("at").alias("at"), F.max_by("payload", "at").alias("payload"))


def output_name(name: Column, language: Column, extension: str) -> Column:
    """report.pdf in language my as report-my.docx."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-"), language, F.lit("." + extension))


def import_bundle(raw: DataFrame, stores: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Every store with the bundle's records merged in by their key; later copies of a key in the bundle are arbitrary but one.

    raw: store, record (JSON), as bundle() writes it. Stores that aren't known,
    records that aren't JSON and records without a key are passed over.
    """
    out = {}
    for name, (df, key) in stores.items():
        got = raw.where(F.col("store") == name).select(F.from_json("record", df.schema).alias("r")).select("r.*").where(F.col(key).isNotNull())
        plain = [c for c, t in got.dtypes if "map" not in t]
        got = got.groupBy(key).agg(F.max(F.struct(*[c for c in plain if c != key])).alias("r")).select(key, "r.*")
        out[name] = upsert(df, got.select(*df.columns), key)
    return out


def sync_status(queue: DataFrame, by: str) -> DataFrame:
    """(by, pending, failed, last_done) of a push queue: state, updated_at."""
    s = F.col("state")
    return queue.groupBy(by).agg(F.count_if(s == "pending").alias("pending"), F.count_if(s == "failed").alias("failed"), F.max(F.when(s == "done", F.col("updated_at"))).alias("last_done"))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """(job_id, artifact_id): the newest ready artifact of each job; ties to the greater id."""
    return artifacts.groupBy("job_id").agg(F.max(F.struct("at", "artifact_id")).alias("x")).select("job_id", "x.artifact_id")


def prunable(artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Artifacts whose job is missing, completed or cancelled."""
    live = jobs.where(~F.col("state").isin("completed", "cancelled")).select("job_id")
    return artifacts.join(live, "job_id", "left_anti")


def actionable(link: Column) -> Column:
    """Whether a link may be followed: web and mail addresses only."""
    return F.coalesce(link, F.lit("")).rlike(r"^(?i:https?://|mailto:)")


def jobs(df: DataFrame, project=None, states: list[str] | None = None) -> DataFrame:
    """The jobs of a project and in some states; what is None doesn't restrict."""
    if project is not None:
        df = df.where(F.col("project_id") == project)
    return df.where(F.col("state").isin(*states)) if states is not None else df


def target_languages(wanted: DataFrame, first: str = "my") -> DataFrame:
    """(target, rank): the languages asked for, once each, ``first`` before the others. A handful of rows is ranked in one task."""
    from pyspark.sql import Window

    few = wanted.where("target IS NOT NULL").distinct()
    return few.select("target", F.row_number().over(Window.orderBy(F.col("target") != first, "target")).cast("bigint").alias("rank"))


#: Fixed value: names of members that are secret.
SECRET_NAME = r"(?i)key|token|secret|password|passphrase|credential|authorization"


def deep_redact(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, record): JSON records with secret members replaced, credentials in texts redacted, and nothing deeper than six levels.

    Text that is no JSON is redacted as text; null stays null.
    """
    import json
    import re

    from folioflow.arrow import map_rows

    def make():
        secret = re.compile(SECRET_NAME)
        wordings = [re.compile(p) for p in T.SECRETS]

        def plain(text):
            for rx in wordings:
                text = rx.sub("[redacted]", text)
            return text

        def walk(v, depth):
            if depth > 6:
                return "[depth-limit]"
            if isinstance(v, str):
                return plain(v)
            if isinstance(v, list):
                return [walk(x, depth + 1) for x in v]
            if isinstance(v, dict):
                return {k: "[redacted]" if secret.search(k) else walk(x, depth + 1) for k, x in v.items()}
            return v

        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(walk(json.loads(text), 0), ensure_ascii=False)
            except ValueError:
                return plain(text)

        return lambda keys, texts: [keys, list(map(one, texts))]

    return map_rows(df.select(key, column), f"{key} {dict(df.dtypes)[key]}, record string", make)


def overlay_errors(patches: DataFrame, catalog: DataFrame, keys: tuple[str, ...], allowed: dict[str, list[str]]) -> DataFrame:
    """(keys…, error): patches of unknown entries, and members whose value isn't allowed."""
    known = catalog.select(*keys).distinct().withColumn("_known", F.lit(True))
    p = patches.join(known, list(keys), "left")
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"{c} not allowed")) for c, v in allowed.items()]
    return p.select(*keys, F.explode(F.array_compact(F.array(F.when(F.col("_known").isNull(), F.lit("unknown entry")), *wrong))).alias("error"))


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """The rows whose owner is gone."""
    return rows.join(owners.select(key).distinct(), key, "left_anti")


def newest_log(log: DataFrame, most: int) -> DataFrame:
    """The newest entries of a log of (at, id, …), newest first, ties to the smaller id."""
    return log.orderBy(F.desc("at"), "id").limit(most)
