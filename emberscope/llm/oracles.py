"""SQL that checks the queries of this package where SQL can express them."""

QUALITY = r"""
WITH words AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents)
), windows AS (
  SELECT doc_id, i, w, lag(w) OVER d AS before,
    CASE WHEN i + 4 <= n THEN concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) END AS five
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, w, before, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS t FROM windows
), covered AS (
  SELECT doc_id, w, before, max(t) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice
), by_word AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars,
    CAST(sum(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS n_repeat_words,
    CAST(sum(CASE WHEN w = before THEN 1 ELSE 0 END) AS BIGINT) AS n_stutters
  FROM covered GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutters, 0) AS n_stutters
  FROM documents d LEFT JOIN by_word USING (doc_id) LEFT JOIN lines USING (doc_id)
), bits AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_stutters > 3 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failures
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters, failures,
  (failures & 3) <> 0 AS base_failed, (failures & (3 + 4 + 16 + 32 + 64)) = 0 AS kept
FROM bits
"""

ABLATIONS = f"""
WITH entries AS ({QUALITY}),
rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32), ('stutter', 64)) AS r(rule, bit)),
policies AS (SELECT * FROM (VALUES ('base', 3), ('v1', 7), ('v2', 119), ('strict', 127)) AS p(policy, bits))
SELECT policy, rule, CAST(count(*) FILTER (failures & bit <> 0) AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (failures & bits = bit) AS BIGINT) AS n_failed_alone,
  CAST(count(*) FILTER (failures & (bits - bit) = 0) AS BIGINT) AS n_kept_without
FROM entries, policies JOIN rules ON bits & bit <> 0 GROUP BY policy, rule
"""

SUBSTRINGS = r"""
WITH words AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents)
), windows AS (
  SELECT doc_id, i, w, n, CASE WHEN i + 19 <= n THEN string_agg(w, ' ') OVER
    (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS twenty FROM words
), later AS (
  SELECT doc_id, i, w, n, twenty IS NOT NULL AND row_number() OVER (PARTITION BY twenty ORDER BY doc_id, i) > 1 AS gone FROM windows
), covered AS (
  SELECT doc_id, i, w, n, max(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM later
), kept AS (
  SELECT doc_id, max(n) AS n_words, count(*) FILTER (c) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT c) AS left_words FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_words, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _scaled(factor: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT))"


def _squared(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _means(of: str, key: str, rows: str) -> str:
    """Per key the list of floor(sum / count) of the components; the division itself has no rest."""
    return f"""SELECT {key}, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT {key}, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT {key}, unnest({of}) AS x, generate_subscripts({of}, 1) AS i FROM {rows}) GROUP BY {key}, i) GROUP BY {key}"""


def vector_codes(rounds: int = 6) -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, {_scaled(4096)} AS v FROM embeddings WHERE {_USABLE})",
        "parts AS MATERIALIZED (SELECT vec_id, q, v[q * (len(v) // 8) + 1 : (q + 1) * (len(v) // 8)] AS v FROM kept, range(8) AS t(q))",
        """b0 AS MATERIALIZED (SELECT q, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e
           FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)) USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, q, v, near.d AS d, near.e AS e FROM (
          SELECT p.vec_id, p.q, any_value(p.v) AS v, min({{'d': {_squared("p.v", "b.v")}, 'e': b.e}}) AS near
          FROM parts p JOIN b{r} b ON p.q = b.q GROUP BY p.vec_id, p.q))""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT q, e, coalesce(m.v, b.v) AS v
              FROM b{r} b LEFT JOIN ({_means("v", "q, e", f"a{r}")}) m USING (q, e))""")
    steps.append(f"""coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a{rounds} GROUP BY vec_id)""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY q, e)) FROM b{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""


def centroids(rounds: int = 10) -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, {_scaled(1024)} AS v FROM embeddings WHERE {_USABLE} AND len(embedding) = 64)",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v
           FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, near.d AS d, near.c AS c FROM (
          SELECT k.vec_id, any_value(k.v) AS v, min({{'d': {_squared("k.v", "c.v")}, 'c': c.c}}) AS near FROM kept k, c{r} c GROUP BY k.vec_id))""")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN ({_means('v', 'c', f'a{r}')}) m USING (c))")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} o USING (c)"""


ORACLES = {
    "op4_quality_rules": QUALITY, "op4_ablations": ABLATIONS, "op5_substring_dedup": SUBSTRINGS,
    "op11_vector_codes": vector_codes(), "op13_centroid_clustering": centroids(),
}
