"""The quality classifier stated in SQL, from the same fixed values."""

from __future__ import annotations

from trailmesh.llm import quality as q


def statement() -> str:
    """Scores of all documents, with source as host and source and language as path."""
    def bins(value: str, edges: tuple) -> str:
        return " + ".join(f"CASE WHEN {value} >= {e} THEN 1 ELSE 0 END" for e in edges)

    values = {
        "symbol_runs": "runs / n", "lone_symbols": "lone / n", "distinct_words": "different / n", "repeats": "same / n",
        "word_length": "(chars - spaces) / n", "capitals": "capitals / greatest(chars, 1)",
        "digits": "digits / greatest(chars, 1)",
    }
    binned = ", ".join(f"{bins(values[k], e)} AS {k}" for k, e in q.EDGES.items())
    stacked = " UNION ALL ".join(
        f"SELECT doc_id, len_class, '{k}' AS name, {k} AS bin FROM binned" for k in q.EDGES)
    grid = " UNION ALL ".join(
        f"SELECT '{k}' AS name, c AS len_class, b AS bin, {len(e) + 1} AS bins "
        f"FROM range({len(q.LENGTHS) + 1}) a(c), range({len(e) + 1}) t(b)" for k, e in q.EDGES.items())
    k, low, high = q.SHRINKAGE, q.LEAST_WEIGHT, q.MOST_WEIGHT

    def weight(n: str, good: str, mean: str, source: str) -> str:
        return f"""
      SELECT greatest({low}, least({high}, coalesce(CASE WHEN share > 0 THEN 1 / share - 1 END, {high}))) AS weight
      FROM (SELECT (sum({n} * pow({good} / {n} - {mean}, 2)) - sum({mean} * (1 - {mean})))
                   / nullif(sum(({n} - 1) * {mean} * (1 - {mean})), 0) AS share FROM {source})"""

    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(text, '{pattern}'))"

    space = "[ \\t\\n\\r]"
    return f"""
    WITH split AS (
      SELECT doc_id, coalesce(source, '') AS host,
             coalesce(source, '') || '/' || coalesce(lang, '') AS path, coalesce(text, '') AS text,
             regexp_split_to_array(trim(coalesce(text, '')), '{space}+') AS w FROM documents),
    measured AS (
      SELECT doc_id, host, path, len(w)::DOUBLE AS n, length(text)::DOUBLE AS chars, {count(q.SYMBOL_RUN)} AS runs,
             {count(q.LONE_SYMBOLS)} AS lone, len(list_distinct(w)) AS different,
             len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] = x[2])) AS same,
             {count(space)} AS spaces, {count('[A-Z]')} AS capitals, {count('[0-9]')} AS digits FROM split),
    binned AS (SELECT doc_id, host, path, {bins('n', q.LENGTHS)} AS len_class, {binned} FROM measured),
    known AS (
      SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS label FROM labels
      WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
    stacked AS ({stacked}),
    grid AS ({grid}),
    seen AS (
      SELECT name, len_class, bin, count(*) FILTER (label = 1) AS h1, count(*) FILTER (label = 0) AS h0
      FROM stacked JOIN known USING (doc_id) GROUP BY ALL),
    filled AS (
      SELECT name, len_class, bin, bins, coalesce(h1, 0)::DOUBLE AS h1, coalesce(h0, 0)::DOUBLE AS h0
      FROM grid LEFT JOIN seen USING (name, len_class, bin)),
    summed AS (
      SELECT *, (sum(h1) OVER (PARTITION BY name, bin) + 1) / (sum(h1) OVER (PARTITION BY name) + bins) AS g1,
             (sum(h0) OVER (PARTITION BY name, bin) + 1) / (sum(h0) OVER (PARTITION BY name) + bins) AS g0,
             sum(h1) OVER (PARTITION BY name, len_class) AS i1, sum(h0) OVER (PARTITION BY name, len_class) AS i0
      FROM filled),
    ratio AS (
      SELECT name, len_class, bin,
             ln(((h1 + {k} * g1) / (i1 + {k})) / ((h0 + {k} * g0) / (i0 + {k}))) AS r FROM summed),
    own AS (
      SELECT doc_id, sum(r) AS evidence FROM stacked JOIN ratio USING (name, len_class, bin) GROUP BY 1),
    base AS (
      SELECT (count(*) FILTER (label = 1) + 1.0) / (count(*) + 2) AS rate
      FROM known JOIN documents USING (doc_id)),
    scored AS (
      SELECT doc_id, host, path, evidence,
             coalesce(label::DOUBLE, 1 / (1 + exp(-(evidence + ln(rate / (1 - rate)))))) AS p
      FROM binned JOIN own USING (doc_id) LEFT JOIN known USING (doc_id), base),
    paths AS (SELECT host, path, count(*)::DOUBLE AS np, sum(p) AS sp FROM scored GROUP BY ALL),
    hosts AS (SELECT host, sum(np) AS nh, sum(sp) AS sh FROM paths GROUP BY 1),
    overall AS (SELECT least(greatest(sum(sh) / sum(nh), 1e-6), 1 - 1e-6) AS m FROM hosts),
    wh AS ({weight('nh', 'sh', 'm', 'hosts, overall')}),
    nested AS (
      SELECT host, path, np, sp, nh, sh, (sh + weight * m) / (nh + weight) AS hm
      FROM paths JOIN hosts USING (host), overall, wh),
    wp AS ({weight('np', 'sp', 'hm', 'nested')}),
    rated AS (
      SELECT doc_id, evidence, p, np, sp, wp.weight AS w,
             (sh - p + wh.weight * m) / (nh - 1 + wh.weight) AS host_rate
      FROM scored JOIN nested USING (host, path), overall, wh, wp),
    sited AS (SELECT *, (sp - p + w * host_rate) / (np - 1 + w) AS path_rate FROM rated)
    SELECT doc_id, round(host_rate, 4) AS host_rate, round(path_rate, 4) AS path_rate,
           round(1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate))))), 4) AS score,
           1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate))))) >= 0.5 AS kept
    FROM sited"""
