"""Every query by name, with the DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.functions import text as X
from entlink.operators import blocking as B
from entlink.operators import evaluation as E
from entlink.operators import export as O
from entlink.operators import knn as N
from entlink.operators import ranking as R
from entlink.operators import sampling as S
from entlink.operators.encoder import HashingEncoder, encode_records
from entlink.operators.export import as_text, completed, import_country, in_input_order, lists, merge_shards, shard_stats, write_shards
from entlink.operators.features import FEATURES, MATCH_FEATURES, RESCUE_FEATURES, fixed_score, labelled, pair_features
from entlink.operators.matching import BASELINE, EMBEDDING, Matcher, compare_arms
from entlink.plans import pipelines as P
from entlink.sources import records as D
from entlink.sources.scratch import packed, scratch_path, stage
from entlink.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
THRESHOLD = P.THRESHOLD


class Case:
    """The tables of one call of a query; what several of its steps need is made once, in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        return packed(D.document_records(self.spark, self.sf_dir), "records")

    @cached_property
    def s1(self) -> DataFrame:
        return self.records.where("source = 1")

    @cached_property
    def truth(self) -> DataFrame:
        return stage(D.document_truth(self.records), "truth")

    @cached_property
    def counts(self) -> DataFrame:
        return stage(D.truth_counts(self.s1, self.truth), "counts")

    @cached_property
    def countries(self) -> DataFrame:
        return self.s1.select(F.col("entity_id").alias("s1"), "country")

    @cached_property
    def sides(self) -> tuple[DataFrame, DataFrame]:
        return P.sides(self.records)

    @cached_property
    def pairs(self) -> DataFrame:
        return stage(B.block_candidates(*self.sides), "pairs")

    @cached_property
    def features(self) -> DataFrame:
        return stage(pair_features(self.pairs, *self.sides), "features")

    @cached_property
    def scored(self) -> DataFrame:
        """Pairs with the fixed score, the lexical score and the label."""
        rows = self.features.select("s1", "cand", fixed_score().alias("score"), R.lexical_score().alias("lexical"), "address_missing")
        return stage(labelled(rows, self.truth), "scored")

    @cached_property
    def lists(self) -> DataFrame:
        return stage(lists(self.s1, self.scored.select("s1", "cand", "score"), THRESHOLD), "lists")

    @cached_property
    def split(self) -> DataFrame:
        return P.splits(self.counts, self.records)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Case], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Case(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


# ---------------------------------------------------------------- SQL building blocks

_FOLD = "replace(lower(coalesce({0}, '')), 'ß', 'ss')"
_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
_LEGAL = ", ".join(f"'{x}'" for x in X.LEGAL)
_ALIAS = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.ADDRESS_ALIAS.items()) + " ELSE t END"
_UNIT = r"(?:^|[^\p{L}\p{N}_])(?:unit|suite|ste|apt|apartment|flat)\s*(?:no\.?\s*)?[:#-]?\s*([\p{L}\p{N}_]+)"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 1)), lambda i: {0}[i] || {0}[i + 1] || {0}[i + 2]))"

REC = r"""raw AS (SELECT doc_id, text, lang, CAST(substr(source, 4) AS INT) % 3 AS g, regexp_extract(text, '^[^.\n]*') AS name FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
rec AS (SELECT g + 1 AS source, 'S' || (g + 1) || '-' || doc_id AS entity_id, name AS business_name, substr(text, length(name) + 1) AS business_address, lang AS country, doc_id AS ord, text
        FROM raw WHERE g > 0 OR doc_id IN (SELECT min(doc_id) FROM raw WHERE g = 0 GROUP BY lang, text)),
truth AS (SELECT a.entity_id AS s1, b.entity_id AS target FROM rec a JOIN rec b ON a.text = b.text AND a.country = b.country WHERE a.source = 1 AND b.source > 1),
tcount AS (SELECT entity_id AS s1, country, ord, count(target) AS n_true FROM rec LEFT JOIN truth ON s1 = entity_id WHERE source = 1 GROUP BY ALL)"""

PREP = (
    REC
    + ",\np0 AS MATERIALIZED (SELECT *, "
    + _WORDS.format(_FOLD.format("business_name"))
    + " AS nw, list_transform(list_filter("
    + _WORDS.format(_FOLD.format("business_address"))
    + f", lambda t: t NOT IN ('null', 'none')), lambda t: {_ALIAS}) AS aw, array_to_string("
    + _WORDS.format(_FOLD.format("country"))
    + f", ' ') AS c, regexp_extract({_FOLD.format('business_address')}, '{_UNIT}', 1) AS unit FROM rec),\n"
    + "p1 AS MATERIALIZED (SELECT *, array_to_string(nw, ' ') AS n, array_to_string(aw, ' ') AS a FROM p0),\n"
    + r"p2 AS MATERIALIZED (SELECT *, list_sort(list_filter(list_distinct(nw), lambda t: t NOT IN ("
    + _LEGAL
    + r"))) AS core, list_distinct(regexp_extract_all(a, '\d+[a-z]*')) AS nums, regexp_extract_all(n, '(?s).') AS nc, regexp_extract_all(a, '(?s).') AS ac FROM p1),"
    + "\nprep AS MATERIALIZED (SELECT source, entity_id, country, ord, c, n, a, core, unit, nums, nw, aw, list_distinct(nw) AS ns, list_distinct(aw) AS ads, "
    + _GRAMS.format("nc")
    + " AS ng, "
    + _GRAMS.format("ac")
    + " AS ag FROM p2)"
)

KEYS = (
    PREP
    + """,
kk AS (SELECT entity_id, source, c, unnest(list_concat([
    CASE WHEN length(array_to_string(core, '')) >= 5 THEN c || '|N|' || array_to_string(core, '') END,
    CASE WHEN length(replace(n, ' ', '')) >= 5 THEN c || '|R|' || replace(n, ' ', '') END,
    CASE WHEN length(a) >= 12 AND len(aw) >= 3 THEN c || '|A|' || array_to_string(list_sort(aw), ' ') END],
    list_transform(list_sort(nums)[1:3], lambda x: c || '|P|' || list_sort(list_transform(list_filter(core, lambda t: length(t) >= 4), lambda t: {'n': -length(t), 't': t}))[1].t || '|' || x))) AS key
  FROM prep WHERE c <> ''),
keys AS (SELECT DISTINCT entity_id, source, c, key FROM kk WHERE key IS NOT NULL),
idx AS (SELECT * FROM keys WHERE source = 1 AND key IN (SELECT key FROM keys WHERE source = 1 GROUP BY key HAVING count(*) <= 30)),
cand AS (SELECT DISTINCT i.entity_id AS s1, k.entity_id AS cand FROM idx i JOIN keys k ON k.key = i.key AND k.c = i.c WHERE k.source > 1)"""
)

_J = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0.0 END"
_C = "CASE WHEN least(len({0}), len({1})) > 0 THEN len(list_intersect({0}, {1})) / least(len({0}), len({1})) ELSE 0.0 END"
_FEATURE_SQL = (
    "(l.n <> '' AND l.n = r.n)::DOUBLE", "(len(l.core) > 0 AND l.core = r.core)::DOUBLE", _J.format("l.ng", "r.ng"), _J.format("l.ns", "r.ns"), _C.format("l.ns", "r.ns"),
    "least(length(l.n), length(r.n)) / greatest(length(l.n), length(r.n), 1)", "(l.a <> '' AND l.a = r.a)::DOUBLE", _J.format("l.ag", "r.ag"), _J.format("l.ads", "r.ads"), _C.format("l.ads", "r.ads"),
    "(l.a = '' OR r.a = '')::DOUBLE", _J.format("l.nums", "r.nums"), "(len(l.nums) > 0 AND len(r.nums) > 0 AND len(list_intersect(l.nums, r.nums)) = 0)::DOUBLE",
    "(l.unit <> '' AND r.unit <> '' AND l.unit = r.unit)::DOUBLE", "(l.unit <> '' AND r.unit <> '' AND l.unit <> r.unit)::DOUBLE", "(l.c <> '' AND l.c = r.c)::DOUBLE", "len(l.ns)::DOUBLE", "len(r.ns)::DOUBLE",
)
FEATS = (
    KEYS
    + ",\nfeats AS MATERIALIZED (SELECT s1, cand, "
    + ", ".join(f"{sql} AS {name}" for sql, name in zip(_FEATURE_SQL, FEATURES, strict=True))
    + " FROM cand JOIN prep l ON l.entity_id = s1 JOIN prep r ON r.entity_id = cand)"
    + ",\nscored AS MATERIALIZED (SELECT s1, cand, 0.5 * name_trigram_jaccard + 0.5 * address_trigram_jaccard AS score, greatest(name_trigram_jaccard, address_trigram_jaccard) + 0.25 * least(name_trigram_jaccard, address_trigram_jaccard) AS lexical, address_missing, (t.s1x IS NOT NULL)::INT AS label"
    + " FROM feats LEFT JOIN (SELECT s1 AS s1x, target AS tx FROM truth) t ON s1x = s1 AND tx = cand)"
)
_F05 = "CASE WHEN n_true = 0 THEN (n_pred = 0)::DOUBLE WHEN 1.25 * n_hit + (n_pred - n_hit) + 0.25 * (n_true - n_hit) > 0 THEN 1.25 * n_hit / (1.25 * n_hit + (n_pred - n_hit) + 0.25 * (n_true - n_hit)) ELSE 0.0 END"
_MACRO = f"round(avg({_F05}), 6) AS macro_f05, sum(n_hit)::BIGINT AS correct, sum(n_pred - n_hit)::BIGINT AS incorrect, sum(n_true - n_hit)::BIGINT AS missed, sum((n_true = 0)::INT)::BIGINT AS singletons, sum((n_true = 0 AND n_pred = 0)::INT)::BIGINT AS singletons_correct"
_PER = "SELECT t.s1, t.country, t.n_true, count(p.cand) AS n_pred, coalesce(sum(p.label), 0) AS n_hit FROM tcount t LEFT JOIN (SELECT * FROM scored WHERE {0}) p ON p.s1 = t.s1 GROUP BY ALL"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- scans and text


@query(f"WITH {REC} SELECT source::BIGINT AS source, entity_id, business_name, business_address, country FROM rec")
def scan_records(c: Case) -> DataFrame:
    return _rounded(c.records.select("source", *D.COLUMNS))


@query(f"WITH {REC} SELECT source::BIGINT AS source, country, count(*) AS n FROM rec GROUP BY ALL")
def source_counts(c: Case) -> DataFrame:
    return _rounded(E.value_counts(c.records, "source", "country"))


@query(f"WITH {REC} SELECT entity_id, row_number() OVER (ORDER BY source, entity_id) - 1 AS rid FROM rec WHERE source > 1")
def dense_pool(c: Case) -> DataFrame:
    records = c.records
    return D.pool({k: records.where(F.col("source") == k) for k in (2, 3)}).select("entity_id", "rid")


@query(f"WITH {PREP} SELECT entity_id, n AS name_norm, a AS addr_norm, array_to_string(core, ' ') AS core, unit, array_to_string(list_sort(nums), ' ') AS numbers, len(ng) AS name_grams, len(ag) AS addr_grams, c AS country_norm FROM prep")
def text_kernel(c: Case) -> DataFrame:
    prep = B.prepared(c.records)
    return prep.select("entity_id", "name_norm", "addr_norm", F.array_join("core", " ").alias("core"), "unit", F.array_join(F.array_sort("numbers"), " ").alias("numbers"), F.size("name_grams").cast("bigint").alias("name_grams"), F.size("addr_grams").cast("bigint").alias("addr_grams"), "country_norm")


@query(rf"WITH {REC} SELECT entity_id, 'query: business name: ' || trim(regexp_replace(business_name, '\s+', ' ', 'g')) || '; address: ' || trim(regexp_replace(business_address, '\s+', ' ', 'g')) AS view FROM rec")
def encoder_views(c: Case) -> DataFrame:
    return c.records.select("entity_id", X.encoder_view(F.col("business_name"), F.col("business_address")).alias("view"))


@query(rf"WITH {REC} SELECT entity_id FROM rec WHERE regexp_replace(business_address, '\s+', '', 'g') = ''")
def blank_addresses(c: Case) -> DataFrame:
    return c.records.where(X.is_blank(F.col("business_address"))).select("entity_id")


@query("SELECT conv_id, turn, len(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM conversations")
def parsed_lists(c: Case) -> DataFrame:
    return c.table("conversations").select("conv_id", "turn", F.size(X.parse_list(F.col("text"))).cast("bigint").alias("n"))


# ---------------------------------------------------------------- candidates and features


@query(f"WITH {KEYS} SELECT entity_id, key FROM keys")
def block_keys(c: Case) -> DataFrame:
    return B.keyed(B.prepared(c.records)).select("entity_id", "key")


@query(f"WITH {KEYS} SELECT key, count(*) AS n FROM keys WHERE source = 1 GROUP BY key")
def key_frequencies(c: Case) -> DataFrame:
    return B.keyed(c.sides[0]).groupBy("key").agg(F.count("key").alias("n"))


@query("WITH k AS (SELECT p_partkey, p_name AS key FROM part UNION ALL SELECT p_partkey, p_name || '|' || p_brand FROM part) SELECT p_partkey, key FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) <= 30)")
def block_cap(c: Case) -> DataFrame:
    part = c.table("part")
    return B.block_index(part.select("p_partkey", F.explode(F.array("p_name", F.concat_ws("|", "p_name", "p_brand"))).alias("key"))).select("p_partkey", "key")


@query(f"WITH {KEYS} SELECT s1, cand FROM cand")
def candidate_pairs(c: Case) -> DataFrame:
    return B.block_candidates(*c.sides)


@query(f"WITH {KEYS} SELECT t.s1, n_true, count(cand) AS n_candidates FROM tcount t LEFT JOIN cand ON cand.s1 = t.s1 GROUP BY ALL")
def candidate_counts(c: Case) -> DataFrame:
    return E.per_business(c.counts, c.pairs.withColumn("label", F.lit(0))).select("s1", "n_true", F.col("n_pred").alias("n_candidates"))


@query(f"WITH {FEATS} SELECT s1, cand, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM feats")
def pair_feature_table(c: Case) -> DataFrame:
    return _rounded(c.features)


@query(f"WITH {FEATS} SELECT s1, cand, label::BIGINT AS label FROM scored")
def labelled_pairs(c: Case) -> DataFrame:
    return _rounded(c.scored.select("s1", "cand", "label"))


@query(f"WITH {REC} SELECT s1, n_true FROM tcount")
def truth_sizes(c: Case) -> DataFrame:
    return c.counts


# ---------------------------------------------------------------- evaluation


@query(f"WITH {FEATS} SELECT {_MACRO} FROM ({_PER.format(f'score >= {THRESHOLD}')})")
def macro_score(c: Case) -> DataFrame:
    return _rounded(E.macro(E.per_business(c.counts, c.scored.where(F.col("score") >= THRESHOLD))))


@query(f"WITH {FEATS} SELECT country, {_MACRO} FROM ({_PER.format(f'score >= {THRESHOLD}')}) GROUP BY country")
def macro_by_country(c: Case) -> DataFrame:
    rows = E.per_business(c.counts.join(c.countries, "s1"), c.scored.where(F.col("score") >= THRESHOLD))
    return _rounded(E.macro(rows, ("country",)))


_GRID = "[" + ", ".join(f"{t!r}::DOUBLE" for t in E.threshold_grid()) + "]"
_TUNED = f"g AS (SELECT unnest({_GRID}) AS threshold), tuned AS (SELECT threshold, {_MACRO} FROM (SELECT g.threshold, t.s1, t.n_true, count(p.cand) AS n_pred, coalesce(sum(p.label), 0) AS n_hit FROM tcount t CROSS JOIN g LEFT JOIN scored p ON p.s1 = t.s1 AND p.score >= g.threshold GROUP BY ALL) GROUP BY threshold)"


@query(f"WITH {FEATS}, {_TUNED} SELECT * FROM tuned")
def threshold_tuning(c: Case) -> DataFrame:
    return _rounded(E.tune(c.counts, c.scored, E.threshold_grid()))


@query(f"WITH {FEATS}, {_TUNED} SELECT threshold, macro_f05 FROM tuned ORDER BY macro_f05 DESC, threshold DESC LIMIT 1")
def best_threshold(c: Case) -> DataFrame:
    return E.best_threshold(_rounded(E.tune(c.counts, c.scored, E.threshold_grid())))


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(lexical, 9) DESC, cand) AS rank FROM scored)"


def _ranked(c: Case, k: int | None = None) -> DataFrame:
    """Lexical ranks; scores that agree in nine places are ties."""
    return R.top_k(c.scored.withColumn("lexical", F.round("lexical", 9)), k, "s1", "lexical")


@query(f"WITH {FEATS}, {_RANKED} SELECT s1, cand, rank::BIGINT AS rank FROM ranked")
def lexical_rank(c: Case) -> DataFrame:
    return _rounded(_ranked(c).select("s1", "cand", "rank"))


@query(
    f"""WITH {FEATS}, {_RANKED}, ks AS (SELECT unnest([1, 10, 20, 50]) AS k),
per AS (SELECT k, t.s1, n_true, count(r.cand) AS n, coalesce(sum(r.label), 0) AS hit FROM tcount t CROSS JOIN ks LEFT JOIN ranked r ON r.s1 = t.s1 AND r.rank <= k GROUP BY ALL)
SELECT k::BIGINT AS k, sum(hit)::BIGINT AS found, sum(n_true)::BIGINT AS true_links, round(CASE WHEN sum(n_true) > 0 THEN sum(hit) / sum(n_true) ELSE 1.0 END, 6) AS recall, round(avg(n), 6) AS mean_size, round(quantile_cont(n, 0.95), 6) AS p95_size, max(n) AS max_size FROM per GROUP BY k"""
)
def recall_report(c: Case) -> DataFrame:
    return _rounded(E.recall_report(c.counts, _ranked(c), (1, 10, 20, 50)))


def _detail(c: Case) -> DataFrame:
    return E.retrieval_detail(c.counts, c.truth, c.scored, c.scored.where("lexical >= 1.25 - 1e-9"))


_DETAIL = """det AS (SELECT t.s1, t.n_true, count(s.cand) AS candidates, coalesce(sum(s.label), 0) AS hits, coalesce(sum(CASE WHEN s.label = 1 AND s.lexical < 1.25 - 1e-9 THEN 1 ELSE 0 END), 0) AS recovered, t.n_true - coalesce(sum(s.label), 0) AS missed
FROM tcount t LEFT JOIN scored s ON s.s1 = t.s1 GROUP BY t.s1, t.n_true)"""


@query(f"WITH {FEATS}, {_DETAIL} SELECT s1, n_true, candidates, hits::BIGINT AS hits, recovered::BIGINT AS recovered, missed::BIGINT AS missed FROM det")
def retrieval_detail(c: Case) -> DataFrame:
    return _rounded(_detail(c))


@query(
    f"""WITH {FEATS}, {_DETAIL} SELECT round(sum(hits) / greatest(sum(n_true), 1), 6) AS link_recall, round(avg(CASE WHEN n_true > 0 THEN hits / n_true END), 6) AS macro_recall, round(avg(candidates), 6) AS mean_candidates,
round(quantile_cont(candidates, 0.95), 6) AS p95_candidates, max(candidates) AS max_candidates, sum(recovered)::BIGINT AS recovered_over_exact, sum((n_true > 0 AND hits = n_true)::INT)::BIGINT AS all_retrieved, sum((n_true = 0)::INT)::BIGINT AS singletons FROM det"""
)
def retrieval_summary(c: Case) -> DataFrame:
    return _rounded(E.retrieval_summary(_detail(c)))


@query(f"WITH {FEATS} SELECT CASE WHEN score IS NULL THEN 'missed_by_search' WHEN score < {THRESHOLD} THEN 'retrieved_but_rejected' ELSE 'accepted' END AS status, count(*) AS links FROM truth t LEFT JOIN scored s ON s.s1 = t.s1 AND s.cand = t.target GROUP BY 1")
def miss_split(c: Case) -> DataFrame:
    return E.miss_split(c.truth, c.scored, THRESHOLD)


@query(f"WITH {KEYS}, n AS (SELECT least(count(cand), 20) AS size FROM tcount t LEFT JOIN cand ON cand.s1 = t.s1 GROUP BY t.s1) SELECT r.range AS size, count(n.size) AS n FROM range(21) r LEFT JOIN n ON n.size = r.range GROUP BY ALL")
def size_histogram(c: Case) -> DataFrame:
    return E.size_histogram(c.counts, c.pairs)


_BLANK = r"blank AS (SELECT entity_id AS target FROM rec WHERE source > 1 AND regexp_replace(business_address, '\s+', '', 'g') = '')"


@query(
    f"""WITH {FEATS}, {_BLANK} SELECT (b.target IS NOT NULL) AS address_missing, count(*) AS true_links, count(s.score) AS retrieved, sum((coalesce(s.score, -1) >= {THRESHOLD})::INT)::BIGINT AS accepted, round(count(s.score) / count(*), 6) AS recall
FROM truth t LEFT JOIN blank b ON b.target = t.target LEFT JOIN scored s ON s.s1 = t.s1 AND s.cand = t.target GROUP BY 1"""
)
def slice_report(c: Case) -> DataFrame:
    blank = c.records.where((F.col("source") > 1) & X.is_blank(F.col("business_address"))).select(F.col("entity_id").alias("target"))
    return _rounded(E.slice_report(c.truth, c.scored, blank, THRESHOLD))


@query(
    f"""WITH {FEATS} SELECT scope, address_missing, count(*) AS pairs, sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives FROM
(SELECT 'all' AS scope, address_missing > 0 AS address_missing, label FROM scored UNION ALL SELECT 'accepted', address_missing > 0, label FROM scored WHERE score >= {THRESHOLD}) GROUP BY ALL"""
)
def pair_audit(c: Case) -> DataFrame:
    scored = c.scored
    return _rounded(E.pair_audit({"all": scored, "accepted": scored.where(F.col("score") >= THRESHOLD)}))


@query(
    f"""WITH {FEATS}, per AS (SELECT t.s1, count(s.cand) AS c, coalesce(sum((s.score >= {THRESHOLD})::INT), 0) AS m FROM tcount t LEFT JOIN scored s ON s.s1 = t.s1 GROUP BY t.s1)
SELECT count(*) AS rows, sum(c)::BIGINT AS candidate_pairs, sum(m)::BIGINT AS predicted_links, sum((c = 0)::INT)::BIGINT AS empty_candidates, sum((m = 0)::INT)::BIGINT AS empty_matches, round(avg(c), 6) AS mean_candidates FROM per"""
)
def run_summary(c: Case) -> DataFrame:
    return _rounded(E.summary(c.counts, c.scored, THRESHOLD))


@query(f"WITH {FEATS}, {_RANKED} SELECT t.s1, t.target, CASE WHEN rank IS NULL THEN 'absent_from_ann' WHEN rank > 20 THEN 'outside_top20' WHEN score >= {THRESHOLD} THEN 'classifier_accepted' ELSE 'classifier_rejected' END AS status FROM truth t LEFT JOIN ranked r ON r.s1 = t.s1 AND r.cand = t.target")
def rank_status(c: Case) -> DataFrame:
    return R.rank_status(c.truth, _ranked(c), THRESHOLD)


# ---------------------------------------------------------------- lists and exports

_LISTS = f"SELECT t.ord, t.s1, coalesce(string_agg(s.cand, ',' ORDER BY {{0}}), '') AS candidates, coalesce(string_agg(s.cand, ',' ORDER BY {{0}}) FILTER (WHERE s.score >= {THRESHOLD}), '') AS matches FROM tcount t LEFT JOIN scored s ON s.s1 = t.s1 GROUP BY t.ord, t.s1"


@query(f"WITH {FEATS} {_LISTS.format('s.cand')}")
def match_lists(c: Case) -> DataFrame:
    """The flagship: every record of source 1 with its candidates and matches."""
    return as_text(c.lists)


@query(f"WITH {FEATS} {_LISTS.format('round(s.score, 9) DESC, s.cand')}")
def ranked_match_lists(c: Case) -> DataFrame:
    scored = c.features.select("s1", "cand", F.round(fixed_score(), 9).alias("score"))
    return as_text(lists(c.s1, scored, THRESHOLD, "rank"))


@query(
    f"""WITH {FEATS}, per AS (SELECT t.ord, count(s.cand) AS c, coalesce(sum((s.score >= {THRESHOLD})::INT), 0) AS m, row_number() OVER (ORDER BY t.ord) - 1 AS place FROM tcount t LEFT JOIN scored s ON s.s1 = t.s1 GROUP BY t.s1, t.ord)
SELECT place // 2000 AS shard, count(*) AS rows, sum(c)::BIGINT AS candidate_pairs, sum(m)::BIGINT AS predicted_links, min(place) AS first, max(place) AS last FROM per GROUP BY 1"""
)
def export_shards(c: Case) -> DataFrame:
    return _rounded(shard_stats(D.with_dense_id(c.lists, ["ord"], "place")))


@query(f"WITH {FEATS} {_LISTS.format('s.cand')}")
def merged_shards(c: Case) -> DataFrame:
    """The lists written in shards of 100 rows, checked and merged again."""
    path = scratch_path(c.spark, "shards")
    placed = stage(D.with_dense_id(c.lists, ["ord"], "place"), "placed")
    write_shards(placed, path, 100)
    merged = merge_shards(c.spark, path, 100)
    return as_text(merged.join(placed.select("place", "ord"), "place"))


@query(f"WITH {FEATS} SELECT len(string_split(nullif(candidates, ''), ',')) AS size, count(*) AS n FROM ({_LISTS.format('s.cand')}) GROUP BY ALL".replace("len(string_split(nullif(candidates, ''), ','))", "coalesce(len(string_split(nullif(candidates, ''), ',')), 0)"))
def candidate_histogram(c: Case) -> DataFrame:
    return O.candidate_histogram(c.lists)


_TOP = f"SELECT t.ord, t.s1, coalesce(string_agg(s.cand, ',' ORDER BY round(s.score, 9) DESC, s.cand) FILTER (WHERE r <= 20), '') AS candidates, coalesce(string_agg(s.cand, ',' ORDER BY round(s.score, 9) DESC, s.cand) FILTER (WHERE r <= 20 AND s.score >= {THRESHOLD}), '') AS matches FROM tcount t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 9) DESC, cand) AS r FROM scored) s ON s.s1 = t.s1 GROUP BY t.ord, t.s1"


@query(f"WITH {FEATS} {_TOP}")
def imported_countries(c: Case) -> DataFrame:
    """Lists of 20 taken over country by country, one of them twice, and put in the order of the input."""
    top = R.top_k(c.features.select("s1", "cand", F.round(fixed_score(), 9).alias("score")), 20)
    rows, path = stage(lists(c.s1, top, THRESHOLD, "rank").join(c.countries, "s1"), "rows"), scratch_path(c.spark, "import")
    names = sorted(r[0] for r in c.countries.select("country").distinct().collect())
    for country in [*names, *names[:1]]:
        import_country(rows.where(F.col("country") == country), c.s1.where(F.col("country") == country), country, path)
    if completed(c.spark, path) != names:
        raise ValueError("a country is missing")
    return as_text(in_input_order(c.spark, path, c.s1))


_RULES = ("missing_row", "unknown_row", "repeated_row", "match_not_candidate", "repeated_candidate", "wrong_source", "wrong_country")
_VIOLATIONS = """ids AS (SELECT entity_id AS s1, country FROM rec WHERE source = 1),
flat AS (SELECT r.s1, unnest(r.candidates) AS cand FROM results r),
known AS (SELECT flat.*, rec.source, rec.country AS there, ids.country AS here FROM flat LEFT JOIN rec ON rec.entity_id = flat.cand LEFT JOIN ids ON ids.s1 = flat.s1)
SELECT 'missing_row' AS rule, count(*) AS n FROM ids WHERE s1 NOT IN (SELECT s1 FROM results)
UNION ALL SELECT 'unknown_row', count(*) FROM results WHERE s1 NOT IN (SELECT s1 FROM ids)
UNION ALL SELECT 'repeated_row', count(*) FROM (SELECT s1 FROM results GROUP BY s1 HAVING count(*) > 1)
UNION ALL SELECT 'match_not_candidate', count(*) FROM results WHERE len(list_filter(matches, lambda m: NOT list_contains(candidates, m))) > 0
UNION ALL SELECT 'repeated_candidate', count(*) FROM results WHERE len(list_distinct(candidates)) < len(candidates)
UNION ALL SELECT 'wrong_source', count(*) FROM known WHERE source IS NULL OR source = 1
UNION ALL SELECT 'wrong_country', count(*) FROM known WHERE here <> there"""
_AS_LISTS = f"good AS (SELECT t.ord, t.s1, coalesce(list(s.cand ORDER BY s.cand) FILTER (WHERE s.cand IS NOT NULL), []) AS candidates, coalesce(list(s.cand ORDER BY s.cand) FILTER (WHERE s.score >= {THRESHOLD}), []) AS matches FROM tcount t LEFT JOIN scored s ON s.s1 = t.s1 GROUP BY t.ord, t.s1)"


@query(f"WITH {FEATS}, {_AS_LISTS}, results AS (SELECT * FROM good), {_VIOLATIONS}")
def integrity(c: Case) -> DataFrame:
    return E.violations(c.s1, c.lists, c.records, every=True)


@query(
    f"""WITH {FEATS}, {_AS_LISTS}, lens AS (SELECT min(entity_id) AS odd FROM rec WHERE source = 2),
results AS (SELECT CASE WHEN ord % 11 = 3 THEN s1 || 'x' ELSE s1 END AS s1,
    list_concat(candidates, CASE WHEN ord % 5 = 1 THEN [s1] ELSE [] END, CASE WHEN ord % 3 = 1 THEN [odd, odd] ELSE [] END) AS candidates,
    list_concat(matches, CASE WHEN ord % 4 = 1 THEN ['S2-none'] ELSE [] END) AS matches
  FROM (SELECT * FROM good WHERE ord % 7 <> 2 UNION ALL SELECT * FROM good WHERE ord % 13 = 4) CROSS JOIN lens), {_VIOLATIONS}"""
)
def broken_integrity(c: Case) -> DataFrame:
    """The rules counted on lists of which many are broken on purpose."""
    odd = c.records.where("source = 2").agg(F.min("entity_id").alias("odd"))
    none = F.array().cast("array<string>")
    rows = c.lists.where("ord % 7 <> 2").unionByName(c.lists.where("ord % 13 = 4")).join(F.broadcast(odd))
    broken = rows.select(
        F.when(F.col("ord") % 11 == 3, F.concat("s1", F.lit("x"))).otherwise(F.col("s1")).alias("s1"),
        F.concat("candidates", F.when(F.col("ord") % 5 == 1, F.array("s1")).otherwise(none), F.when(F.col("ord") % 3 == 1, F.array("odd", "odd")).otherwise(none)).alias("candidates"),
        F.concat("matches", F.when(F.col("ord") % 4 == 1, F.array(F.lit("S2-none"))).otherwise(none)).alias("matches"),
    )
    return E.violations(c.s1, broken, c.records, every=True)


_TWO = _RANKED + ", byscore AS (SELECT s1, cand, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 9) DESC, cand) AS rank FROM scored)"


def _two(c: Case) -> tuple[DataFrame, DataFrame]:
    scored = c.scored
    return R.top_k(scored.withColumn("lexical", F.round("lexical", 9)), None, "s1", "lexical"), R.top_k(scored.withColumn("score", F.round("score", 9)))


@query(
    f"""WITH {FEATS}, {_TWO}, fused AS (SELECT s1, cand, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT s1, cand, rank FROM ranked UNION ALL SELECT s1, cand, rank FROM byscore) GROUP BY ALL)
SELECT s1, cand, round(score, 6) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) <= 50"""
)
def rank_fusion(c: Case) -> DataFrame:
    fused = R.reciprocal_rank_fusion(list(_two(c)), None).withColumn("score", F.round("score", 9)).drop("rank")
    return _rounded(R.top_k(fused, 50).select("s1", "cand", "score"))


_ARRAYS = "lx AS (SELECT s1, list(cand ORDER BY rank) AS a FROM ranked GROUP BY s1), sc AS (SELECT s1, list(cand ORDER BY cand) AS b FROM byscore GROUP BY s1)"
_DEDUP = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(f"WITH {FEATS}, {_TWO}, {_ARRAYS}, m AS (SELECT s1, list_concat(a[1:2], b[1:2], b, a) AS ab FROM lx JOIN sc USING (s1)) SELECT s1, array_to_string({_DEDUP.format('ab')}[1:4], ',') AS merged FROM m")
def hybrid_merge(c: Case) -> DataFrame:
    lexical, score = _two(c)
    a, b = R.ranked_lists(lexical, "a"), R.ranked_lists(R.top_k(score.drop("rank").withColumn("one", F.lit(1.0)), None, "s1", "one"), "b")
    return a.join(b, "s1").select("s1", F.array_join(R.hybrid(F.col("a"), F.col("b"), 4), ",").alias("merged"))


@query(
    f"""WITH {FEATS}, {_TWO}, {_ARRAYS}, m AS (SELECT s1, a[1:20] AS base, b AS names FROM lx JOIN sc USING (s1)),
p AS (SELECT s1, base, list_concat(base, names[1:5]) AS n5, list_concat(base, names[1:10]) AS n10, list_concat(base, names[1:20]) AS n20, list_concat(base[1:15], names[1:5], base) AS bud FROM m)
SELECT s1, len(base) AS baseline20, len({_DEDUP.format("n5")}) AS plus_name5, len({_DEDUP.format("n10")}) AS plus_name10, len({_DEDUP.format("n20")}) AS plus_name20, array_to_string({_DEDUP.format("bud")}[1:20], ',') AS budget20 FROM p"""
)
def rescue_lists(c: Case) -> DataFrame:
    lexical, score = _two(c)
    a, b = R.ranked_lists(lexical.where("rank <= 20"), "a"), R.ranked_lists(R.top_k(score.drop("rank").withColumn("one", F.lit(1.0)), None, "s1", "one"), "b")
    policies = R.rescue_policies(F.col("a"), F.col("b"))
    return a.join(b, "s1").select("s1", *[F.size(policies[p]).cast("bigint").alias(p) for p in ("baseline20", "plus_name5", "plus_name10", "plus_name20")], F.array_join(policies["budget20"], ",").alias("budget20"))


_SETTINGS = "settings AS (SELECT p_size AS nprobe, p_brand AS brand, round(avg(p_retailprice), 6) AS macro_f05, count(*)::DOUBLE AS seconds, count(*) AS found FROM part GROUP BY ALL)"


def _settings(c: Case) -> DataFrame:
    """A table of many settings to compare: parts by size and brand."""
    rows = c.table("part").groupBy(F.col("p_size").cast("bigint").alias("nprobe"), F.col("p_brand").alias("brand"))
    return rows.agg(F.round(F.avg("p_retailprice"), 6).alias("macro_f05"), F.count("p_partkey").cast("double").alias("seconds"), F.count("p_partkey").alias("found"))


@query(f"WITH {_SETTINGS} SELECT nprobe::BIGINT AS nprobe, brand, macro_f05, seconds FROM settings a WHERE NOT EXISTS (SELECT 1 FROM settings b WHERE b.macro_f05 >= a.macro_f05 AND b.seconds <= a.seconds AND (b.macro_f05 > a.macro_f05 OR b.seconds < a.seconds))")
def pareto_settings(c: Case) -> DataFrame:
    return R.pareto(_settings(c)).select("nprobe", "brand", "macro_f05", "seconds")


@query(f"WITH {_SETTINGS}, one AS (SELECT * FROM settings ORDER BY nprobe, brand LIMIT 1) SELECT s.nprobe::BIGINT AS nprobe, s.brand, s.found - one.found AS extra_true_retrieved, round(s.macro_f05 - one.macro_f05, 4) AS macro_f05_change, round(s.seconds / one.seconds, 6) AS time_ratio FROM settings s CROSS JOIN one")
def against_baseline(c: Case) -> DataFrame:
    rows = _settings(c)
    first = rows.orderBy("nprobe", "brand").first()
    out = R.against_baseline(rows, (F.col("nprobe") == first["nprobe"]) & (F.col("brand") == first["brand"]))
    return out.select("nprobe", "brand", "extra_true_retrieved", F.round("macro_f05_change", 4).alias("macro_f05_change"), F.round("time_ratio", 6).alias("time_ratio"))


@query("SELECT p_size::BIGINT AS nprobe, " + ", ".join(f"count(*) FILTER (WHERE p_partkey % 3 = {i})::DOUBLE AS \"{k}\"" for i, k in enumerate((200, 400, 800))) + " FROM part GROUP BY 1")
def recall_pivot(c: Case) -> DataFrame:
    kind = F.element_at(F.array(F.lit(200), F.lit(400), F.lit(800)), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = c.table("part").groupBy(F.col("p_size").cast("bigint").alias("nprobe"), kind.alias("overfetch")).agg(F.count("p_partkey").cast("double").alias("recall"))
    return R.recall_table(rows, (200, 400, 800)).na.fill(0.0)


# ---------------------------------------------------------------- vectors


def _vectors(c: Case) -> tuple[DataFrame, DataFrame]:
    """Every vector; as queries those whose id is divisible by 50."""
    rows = c.table("embeddings").select((F.col("label") % 3).cast("string").alias("country"), "vec_id", F.col("embedding").alias("vector"))
    return rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q"), rows.withColumnRenamed("vec_id", "rid")


_VEC = "e AS (SELECT vec_id, label % 3 AS c, embedding::DOUBLE[] AS v FROM embeddings), cs AS (SELECT a.vec_id AS q, b.vec_id AS rid, list_cosine_similarity(a.v, b.v) AS cosine FROM e a JOIN e b ON a.c = b.c WHERE a.vec_id % 50 = 0)"


@query(f"WITH {_VEC} SELECT q, rid, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, rid)::BIGINT AS rank FROM cs QUALIFY rank <= 20")
def exact_neighbours(c: Case) -> DataFrame:
    return _rounded(N.exact_neighbours(*_vectors(c), k=20).select("q", "rid", "rank"))


@query(f"WITH {_VEC} SELECT q, rid, round(cosine, 5) AS cosine FROM cs")
def cosines(c: Case) -> DataFrame:
    return N.all_cosines(*_vectors(c)).withColumn("cosine", F.round("cosine", 5))


@query(
    f"""WITH {_VEC}, target AS (SELECT q, max(rid) AS target FROM cs GROUP BY q), pos AS (SELECT target.q, target, cosine AS t FROM target JOIN cs ON cs.q = target.q AND cs.rid = target)
SELECT pos.q, target, (sum((cosine > t + 1e-6)::INT) + 1)::BIGINT AS first_rank, (sum((cosine > t + 1e-6)::INT) + sum((abs(cosine - t) <= 1e-6 AND rid <> target)::INT) + 1)::BIGINT AS last_rank FROM pos JOIN cs ON cs.q = pos.q GROUP BY ALL"""
)
def rank_intervals(c: Case) -> DataFrame:
    queries, pool = _vectors(c)
    targets = queries.select("q", "country").join(pool.groupBy("country").agg(F.max("rid").alias("rid")), "country").select("q", "rid")
    return N.rank_intervals(targets, queries, pool)


def _half(index: N.CellIndex) -> N.Profile:
    """The standard profile, but at least half of the largest country's cells: a fixed number of probes finds less the more cells there are."""
    standard = N.PROFILES["standard"]
    return N.Profile(max(standard.nprobe, (max((len(m.centroids) for m in index.models.values()), default=0) + 1) // 2), standard.overfetch)


@query()
def cell_neighbours(c: Case) -> DataFrame:
    queries, pool = _vectors(c)
    index = N.build_cells(pool, flat_below=100)
    return N.cell_neighbours(queries, index, _half(index))


@query()
def encoded_records(c: Case) -> DataFrame:
    return encode_records(c.records.select("entity_id", "business_name", "business_address"), HashingEncoder()).select("entity_id", "vector")


@query()
def name_rescue(c: Case) -> DataFrame:
    """The closest five records without an address, by name alone."""
    return P.rescued(c.records, P.name_vectors(c.records, HashingEncoder()))


@query()
def embedding_pairs(c: Case) -> DataFrame:
    """Features and embedding cosine of the pairs that the search finds."""
    return _rounded(P.embedding_features(c.records, P.Search.build(c.records, HashingEncoder())))


@query()
def embedding_matches(c: Case) -> DataFrame:
    """The selected pipeline from encoder to lists of at most 20."""
    return as_text(P.embedding_matched(c.records, c.truth, c.counts, HashingEncoder())[1])


@query()
def search_ablation(c: Case) -> DataFrame:
    """Nine settings in random order, the standard one before and after them: recall at 20, macro F0.5 of one model, and time."""
    search = P.Search.build(c.records, HashingEncoder(), flat_below=100)
    return P.ablation(search, c.records, c.truth, c.counts, c.split)


@query()
def model_arms(c: Case) -> DataFrame:
    """Models fitted on pairs of the search alone or with those by name, with and without the name's cosine; tuned and compared."""
    ready = stage(labelled(P.rescue_features(c.records, P.Search.build(c.records, HashingEncoder()), HashingEncoder()), c.truth), "ready")
    arms = {"control19": (MATCH_FEATURES, F.col("in_baseline")), "expanded19": (MATCH_FEATURES, F.lit(True)), "expanded20": (RESCUE_FEATURES, F.lit(True))}
    train = ready.join(c.split.where("split = 'train'").select("s1"), "s1", "left_semi").where("in_baseline")
    best, report, _ = compare_arms(ready, c.split, arms, {"saved": Matcher.fit(train, MATCH_FEATURES, **BASELINE)}, **EMBEDDING)
    rows = [(name, r["features"], float(r["threshold"]), float(r["macro_f05"]), name == best, r.get("evaluation_f05")) for name, r in report.items()]
    return c.spark.createDataFrame(rows, "model string, features int, threshold double, tuning_f05 double, selected boolean, evaluation_f05 double")


# ---------------------------------------------------------------- samples, models, streams


@query(f"WITH {REC} SELECT entity_id FROM rec WHERE source = 1 ORDER BY md5('2026|' || entity_id), entity_id LIMIT 100")
def seeded_sample(c: Case) -> DataFrame:
    return S.bottom_k(c.s1.select("entity_id"), 100, 2026)


@query(f"WITH {REC}, old AS (SELECT entity_id FROM rec WHERE source = 1 ORDER BY md5('2026|' || entity_id), entity_id LIMIT 100) SELECT entity_id FROM rec WHERE source = 1 AND entity_id NOT IN (SELECT entity_id FROM old) ORDER BY md5('20260927|' || entity_id), entity_id LIMIT 50")
def fresh_sample(c: Case) -> DataFrame:
    return S.bottom_k(c.s1.select("entity_id"), 50, 20260927, exclude=S.bottom_k(c.s1.select("entity_id"), 100, 2026))


@query(
    f"""WITH {REC}, p AS (SELECT s1, (row_number() OVER (PARTITION BY country, n_true = 0 ORDER BY md5('2026|' || s1), s1) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY country, n_true = 0) AS share FROM tcount)
SELECT s1, CASE WHEN share <= 0.75 THEN 'train' WHEN share <= 0.875 THEN 'tune' ELSE 'evaluation' END AS split FROM p"""
)
def stratified_split(c: Case) -> DataFrame:
    rows = c.counts.join(c.countries, "s1").withColumn("lonely", F.col("n_true") == 0)
    return S.stratified_split(rows, ["country", "lonely"], id_col="s1").select("s1", "split")


@query(
    f"""WITH {KEYS} SELECT target AS entity_id FROM truth UNION SELECT cand FROM cand UNION
(SELECT entity_id FROM rec WHERE source > 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('180|' || entity_id), entity_id) <= 20000)"""
)
def training_pool(c: Case) -> DataFrame:
    others = c.records.where("source > 1")
    return S.training_pool(c.truth, c.pairs, others, 20_000)


@query()
def trained_matches(c: Case) -> DataFrame:
    """Scores of all pairs by trees fitted on the train split."""
    ready = stage(labelled(c.features, c.truth), "ready")
    train = ready.join(c.split.where("split = 'train'").select("s1"), "s1", "left_semi")
    return Matcher.fit(train, **BASELINE).score(ready).select("s1", "cand", "label", "score")


@query(
    f"""WITH {FEATS}, {_RANKED}, sp AS (SELECT s1, n_true, (row_number() OVER (PARTITION BY country, n_true = 0 ORDER BY md5('2026|' || s1), s1) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY country, n_true = 0) AS share FROM tcount),
ks AS (SELECT unnest([10, 20, 50]) AS k), per AS (SELECT CASE WHEN share <= 0.75 THEN 'train' WHEN share <= 0.875 THEN 'tune' ELSE 'evaluation' END AS split, k, t.s1, n_true, count(r.cand) AS n, coalesce(sum(r.label), 0) AS hit FROM sp t CROSS JOIN ks LEFT JOIN ranked r ON r.s1 = t.s1 AND r.rank <= k GROUP BY ALL)
SELECT split, k::BIGINT AS k, sum(hit)::BIGINT AS found, sum(n_true)::BIGINT AS true_links, round(CASE WHEN sum(n_true) > 0 THEN sum(hit) / sum(n_true) ELSE 1.0 END, 6) AS recall, round(avg(n), 6) AS mean_size, round(quantile_cont(n, 0.95), 6) AS p95_size, max(n) AS max_size FROM per GROUP BY split, k"""
)
def recall_by_split(c: Case) -> DataFrame:
    return _rounded(E.recall_report(c.split.select("s1", "n_true", "split"), _ranked(c), by=("split",)))


_OLD_NEW = "SELECT '{0}' AS model, country, macro_f05, correct, incorrect, missed, singletons, singletons_correct FROM (SELECT country, " + _MACRO.replace("{", "{{").replace("}", "}}") + " FROM ({1}) GROUP BY country)"


@query(
    f"WITH {FEATS}, both AS ({_OLD_NEW.format('old', _PER.format(f'score >= {THRESHOLD}'))} UNION ALL {_OLD_NEW.format('new', _PER.format('lexical >= 0.875'))}) SELECT b.*, round(b.macro_f05 - o.macro_f05, 4) AS change FROM both b JOIN both o ON o.country = b.country AND o.model = 'old'".replace("both", "bt")
)
def country_comparison(c: Case) -> DataFrame:
    """Macro F0.5 of each country by the fixed score and by the lexical one."""
    models = {"old": c.scored.where(F.col("score") >= THRESHOLD), "new": c.scored.where("lexical >= 0.875")}
    return _rounded(E.compare_by_country(c.counts.join(c.countries, "s1"), models)).withColumn("change", F.round("change", 4))


@query(f"WITH {REC} SELECT entity_id, business_name FROM rec WHERE source = 1 ORDER BY ord LIMIT 100")
def preview(c: Case) -> DataFrame:
    """The first rows of the input, for a look at it."""
    return D.preview(c.s1, 100).select("entity_id", "business_name")


_FOLDED = (
    ("ﬁne ①2 ½", "fine 12 1 2"), ("ＡＢＣ１２ Ｌｔｄ", "abc12 ltd"), ("ΟΔΟΣ Σίσυφος", "οδοσ σίσυφοσ"), ("STRASSE Straße", "strasse strasse"), ("Ǆungla №5", "džungla no5"),
    ("İstanbul", "i stanbul"), ("É e\u0301", "é é"), ("ſun Ĳssel", "sun ijssel"), ("x²+y³ ™", "x2 y3 tm"), ("plain_text-Only 7", "plain text only 7"), ("", ""),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{y}')" for i, (_, y) in enumerate(_FOLDED)) + ") t(i, folded)")
def folded_texts(c: Case) -> DataFrame:
    """Full folding of texts beyond plain letters; the expected forms are written out."""
    return c.spark.createDataFrame([(i, x) for i, (x, _) in enumerate(_FOLDED)], "i int, text string").select("i", X.norm(F.col("text")).alias("folded"))


@query(f"WITH {FEATS} SELECT s1, cand, round(score, 6) AS score FROM scored")
def streamed_matches(c: Case) -> DataFrame:
    """The stream over all files of sources 2 and 3 gives the batch result."""
    at = scratch_path(c.spark, "stream")
    records = c.records.drop("same")
    others = records.where("source > 1")
    others.repartition(3, "entity_id").write.parquet(f"{at}/in")
    B.prepared(records.where("source = 1")).write.parquet(f"{at}/s1")
    s1 = c.spark.read.parquet(f"{at}/s1")
    B.block_index(B.keyed(s1)).write.parquet(f"{at}/index")
    incremental.start(c.spark, f"{at}/in", others.schema, s1, c.spark.read.parquet(f"{at}/index"), f"{at}/out", f"{at}/checkpoint", settings={"max_block": B.MAX_BLOCK}).awaitTermination()
    return c.spark.read.parquet(f"{at}/out").select("s1", "cand", F.round("score", 6).alias("score"))
