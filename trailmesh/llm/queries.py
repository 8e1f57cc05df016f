"""The registered queries of this subpackage, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.llm import (
    bestfit,
    burst,
    html,
    langid,
    lines,
    minhash,
    packing,
    projection,
    quality,
    quality_sql,
    repeats,
    simhash,
    urls,
    warc,
)
from trailmesh.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def query(sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents have no address: their source stands for the host, source and language for the path."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return quality.classify(docs, labels, F.col("source"), path)


@query(quality_sql.statement())
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.round("host_rate", 4).alias("host_rate"),
                         F.round("path_rate", 4).alias("path_rate"), F.round("score", 4).alias("score"), "kept")


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query("""
    WITH RECURSIVE usable AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    reach AS (
      SELECT vec_id AS a, vec_id AS b FROM embeddings
      UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN lowest ON lowest.a = vec_id LEFT JOIN degree ON degree.a = vec_id""")
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("""
    WITH split AS (
      SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    every AS (
      SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS q FROM split),
    lines AS (
      SELECT doc_id, q, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line,
             row_number() OVER (PARTITION BY doc_id ORDER BY q) AS p FROM every
      WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
    sized AS (
      SELECT *, len(list_filter(regexp_split_to_array(line, '[ \t\r]+'), lambda x: x <> '')) AS words FROM lines),
    pairs AS (
      SELECT a.doc_id AS first_doc, a.p AS first_p, b.doc_id, b.p, b.q, b.words FROM sized a JOIN sized b
      ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.p < b.p)),
    islands AS (
      SELECT *, p - row_number() OVER (PARTITION BY first_doc, doc_id, p - first_p ORDER BY p) AS island FROM pairs),
    runs AS (
      SELECT doc_id, q, sum(words) OVER (PARTITION BY first_doc, doc_id, p - first_p, island) AS total FROM islands),
    gone AS (SELECT DISTINCT doc_id, q FROM runs WHERE total >= 10),
    kept AS (
      SELECT e.doc_id, string_agg(raw, chr(10) ORDER BY e.q) AS text,
             bool_or(trim(raw, ' ' || chr(9) || chr(13)) <> '') AS has_text
      FROM every e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY 1),
    lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
    SELECT d.doc_id, len(l) AS n_lines, coalesce(n, 0) AS n_removed,
           CASE WHEN n IS NULL THEN d.text WHEN has_text THEN k.text ELSE '' END AS text
    FROM split d LEFT JOIN kept k USING (doc_id) LEFT JOIN lost USING (doc_id)""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False)))
    model = langid.fit(docs.filter(~F.col("held_out")))
    found = langid.identify(docs, model)
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("""
    WITH sized AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
      FROM pages),
    firsts AS (
      SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id THEN first END AS refers_to
    FROM sized LEFT JOIN firsts USING (payload_digest)""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _url_sql() -> str:
    def hit(term: str) -> str:
        return f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') THEN 1 ELSE 0 END"

    strict = " + ".join(map(hit, urls.STRICT_TERMS))
    soft = " + ".join(map(hit, urls.SOFT_TERMS))
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in ordered
    ]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)
    return f"""
    WITH cut AS (
      SELECT page_id, translate(coalesce(url, ''), {letters}) AS low,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, low, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
    split AS (
      SELECT page_id, low, translate(raw, {letters}) AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
    counted AS (SELECT *, {strict} AS s, {soft} AS t FROM split)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN s >= 1 OR t >= 2 THEN 'block' ELSE 'allow' END AS verdict FROM counted"""


@query(_url_sql())
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


@query()
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def sql_crc32(text: str) -> str:
    """The unsigned CRC-32 of ASCII text in DuckDB: a byte is mixed in, then eight single bits are shifted out."""
    bits = ", -1" * 8
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split({text}, ''), lambda x: [ord(x)::BIGINT{bits}]))), lambda s, v: CASE
      WHEN v >= 0 THEN xor(s, v) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))"""


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations whose first turns, up to eight, are taken from the one whose id is the next lower multiple of 5."""
    rows = checkpointed(burst.sequences(conversations))  # read twice
    width = burst.WIDTH
    first = rows.filter("conv_id % 5 = 0").select(
        F.col("conv_id").alias("_base"), F.expr(f"substring(ids, 1, 8 * {width})").alias("_ids"),
        F.slice("sizes", 1, 8).alias("_sizes"))
    marked = rows.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"),
                               "_to": F.expr("conv_id - conv_id % 5")})
    joined = marked.join(first, F.col("_to") == F.col("_base"), "left")
    return joined.select(
        "conv_id",
        F.expr(f"concat(substring(coalesce(_ids, X''), 1, h * {width}), substring(ids, h * {width} + 1))").alias("ids"),
        F.expr("concat(slice(coalesce(_sizes, array()), 1, h), slice(sizes, h + 1, size(sizes)))").alias("sizes"))


@query(f"""
    WITH every AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p FROM conversations),
    ids AS (SELECT conv_id, {sql_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
    turns AS (
      SELECT i.conv_id, e.p, role, text FROM ids i JOIN every e ON e.conv_id = i.conv_id - i.conv_id % 5 AND e.p < h
      UNION ALL SELECT conv_id, p, role, text FROM ids JOIN every USING (conv_id) WHERE p >= h),
    named AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, strlen(text) AS bytes,
             dense_rank() OVER (ORDER BY role, text) AS t FROM turns),
    steps AS (
      SELECT conv_id, d, bytes, string_agg(t::VARCHAR, ',') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM named
      UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
    ends AS (SELECT conv_id, max(d) AS last FROM steps GROUP BY 1),
    nodes AS (
      SELECT path, d, min(s.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
             string_agg(CASE WHEN d = last THEN s.conv_id::VARCHAR END, ',' ORDER BY s.conv_id) AS members
      FROM steps s JOIN ends e ON e.conv_id = s.conv_id GROUP BY 1, 2),
    up AS (
      SELECT n.path, n.d, n.n_convs, n.bytes, s.path AS above, s.d AS above_d
      FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.d <= n.d),
    kids AS (SELECT above AS path, count(*) AS n_children FROM up WHERE above_d = d - 1 GROUP BY 1),
    sums AS (
      SELECT above AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
      FROM up LEFT JOIN kids USING (path) GROUP BY 1)
    SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
           leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.members, '')) AS ends_sha256
    FROM nodes n JOIN sums USING (path) LEFT JOIN kids USING (path)
    LEFT JOIN up u ON u.path = n.path AND u.d = n.d AND u.above_d = n.d - 1 LEFT JOIN nodes p ON p.path = u.above""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = burst.prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.withColumnRenamed("ends", "ends_sha256")


def repetitive(docs: DataFrame) -> DataFrame:
    """Every tenth document, by its id's checksum, repeats a stretch of its words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).select(
        "*", F.size("w").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    start, after = F.expr("int(g % n)"), F.expr("int(n - g % n)")
    period = (1 + F.floor(after / (3 + F.col("g") % 8))).cast("int")
    copies = F.array_repeat(F.slice("w", start + 1, period), F.ceil(after / period).cast("int"))
    made = F.slice(F.concat(F.slice("w", F.lit(1), start), F.flatten(copies)), F.lit(1), F.col("n"))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


@query(f"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             {sql_crc32("doc_id::VARCHAR")} AS h FROM documents),
    sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM split),
    placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
    made AS (
      SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
               w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w
      FROM placed),
    words AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM made),
    pairs AS (
      SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
      ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
    stretches AS (
      SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
      HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
    listed AS (
      SELECT doc_id, count(*) AS n_runs,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
             max((length, -start, -period)) AS best FROM runs GROUP BY 1)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -best[2] AS start, best[1] AS length, -best[3] AS period,
           1000 * best[1] // -best[3] AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256,
           sha256(coalesce(k.t, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.word_runs(repetitive(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
