"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.license_scan import TEMPLATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


# crc32 of a text's UTF-8 bytes: the usual table (polynomial 0xEDB88320), made by eight shift steps per entry.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(n::BIGINT, range(8)),
                          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n))"""


def crc32_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


CRC32 = crc32_sql("coalesce(text, '')")


@query("op8_sharding", oracle=f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, source, text, md5(concat('42:', coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS r,
             count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n), h, doc_id) - 1 AS pos FROM r),
s AS (SELECT *, (pos * 40) // total AS shard FROM p)
SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, {CRC32} AS text_crc32, 'rows' AS law,
       shard::INTEGER AS shard, (pos - (shard * total + 39) // 40)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, source
FROM s, crc_table""")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query("op1_line_dedup", oracle=r"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:address|article|aside|blockquote|body|br|div|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|td|th|tr|ul)(?:\s[^>]*)?/?>', chr(10), 'g'),
           '(?s)<[a-zA-Z/!][^>]*>', '', 'g') AS text
  FROM pages),
l AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
k AS (SELECT *, nullif(trim(line, concat(' ', chr(9), chr(13))), '') AS bare FROM l),
c AS (SELECT host, bare, count(DISTINCT page_id) AS n FROM k WHERE bare IS NOT NULL AND host IS NOT NULL GROUP BY 1, 2),
t AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY 1),
b AS (SELECT c.host, c.bare FROM c JOIN t USING (host) WHERE n > 1 AND n > 0.3::DOUBLE * pages),
j AS (SELECT k.*, b.bare IS NOT NULL AS bad FROM k LEFT JOIN b ON k.host = b.host AND k.bare = b.bare)
SELECT page_id, host, count(*)::INTEGER AS n_lines, count(*) FILTER (bad)::INTEGER AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text
FROM j GROUP BY page_id, host""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.line_dedup import dedup_pages

    return dedup_pages(table(spark, sf_dir, "pages"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
                      "span_start", "span_length")


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file of the installed package; it is not copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_exact_top_k_search", oracle="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM r WHERE rank <= 5""")
def op5_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.topk_search import top_k_search

    return top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())


@query("op10_license_scans", oracle=rf"""
WITH t(template, text) AS (VALUES {TEMPLATE_ROWS}),
tw AS (SELECT template, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM t),
ts AS (SELECT DISTINCT template, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
              lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM tw),
n AS (SELECT template, count(*) AS n FROM ts GROUP BY 1),
c AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN n <= 3 THEN 3 WHEN n <= 5 THEN 5 WHEN n <= 9 THEN 9 ELSE 17 END AS hi FROM n),
k AS (SELECT *, CASE WHEN hi = 1 THEN 1 ELSE 2 * hi END AS len, CASE WHEN hi = 1 THEN 1 ELSE hi + 1 END AS step FROM c),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
       FROM documents WHERE text IS NOT NULL),
di AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM dw WHERE len(w) > 0),
ds AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 4], ' ') AS s FROM di),
m AS (SELECT ds.doc_id, ds.pos, ds.s, k.* FROM ds JOIN ts USING (s) JOIN k USING (template)),
x AS (SELECT *, 1 + step * unnest(range(greatest(0, (pos - len + step - 1) // step), (pos - 1) // step + 1)) AS start FROM m),
g AS (SELECT doc_id, template, n, start, count(DISTINCT s) AS found FROM x WHERE pos BETWEEN start AND start + len - 1
      GROUP BY ALL HAVING count(DISTINCT s) >= 0.8::DOUBLE * n - 1e-9)
SELECT doc_id, template, n::INTEGER AS n_shingles, found::INTEGER AS n_found, (start - 1)::INTEGER AS first_window,
       found::DOUBLE / n AS containment
FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY found DESC, start) = 1""")
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs))


@query("op11_periodic_runs", oracle=rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h
      FROM documents, crc_table),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
s AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS m
      FROM (SELECT doc_id, w, unnest(range(n - 15)) AS i FROM x WHERE n >= 24)),
c AS (SELECT doc_id, m, list(i ORDER BY i) AS js FROM s GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT doc_id, js, unnest(js) AS i FROM c),
q AS (SELECT doc_id, i, unnest(list_filter(js, lambda j: j > i)) - i AS q FROM e),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM q),
r AS (SELECT doc_id, min(i) AS s, count(*) + 15 + q AS len, q FROM k GROUP BY doc_id, q, k HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
u AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.doc_id = r.doc_id AND b.q < r.q AND b.s <= r.s AND b.s + b.len >= r.s + r.len)),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM u GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) AS pick FROM u),
z AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM u),
v AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM x),
t AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS text FROM v ANTI JOIN z ON v.doc_id = z.doc_id AND v.i = z.i GROUP BY 1)
SELECT x.doc_id, coalesce(o.n_runs, 0)::BIGINT AS n_runs, f.s::BIGINT AS start, f.len::BIGINT AS length, f.q::BIGINT AS period,
       ((1000 * f.len) // f.q)::BIGINT AS exponent_milli, sha256(coalesce(o.lines, '')) AS runs_sha256,
       sha256(coalesce(t.text, '')) AS collapsed_sha256
FROM x LEFT JOIN o ON o.doc_id = x.doc_id LEFT JOIN f ON f.doc_id = x.doc_id AND f.pick = 1 LEFT JOIN t ON t.doc_id = x.doc_id""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.periodic_runs import periodic_runs, repeat_tails, run_digests

    return run_digests(periodic_runs(repeat_tails(table(spark, sf_dir, "documents"))))


@query("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.simhash import simhash_near_dedup

    return simhash_near_dedup(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants", oracle=f"""
WITH RECURSIVE {CRC_TABLE},
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
      GROUP BY ALL),
h AS (SELECT w, c, {crc32_sql("doc_id || ':' || w")} AS h FROM l, crc_table WHERE length(w) >= 6),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM i),
p AS (SELECT a.word, b.word AS other FROM k a JOIN k b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
      UNION SELECT k.word, v.word FROM k JOIN v ON k.k = v.word UNION SELECT v.word, k.word FROM k JOIN v ON k.k = v.word),
r AS (SELECT p.word, p.other, o.n AS other_n, v.n, count(*) OVER (PARTITION BY p.word) AS n_near,
             row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS pick
      FROM p JOIN v o ON o.word = p.other JOIN v ON v.word = p.word),
f AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * v.n THEN r.other END AS form,
             CASE WHEN r.other_n >= 5 * v.n THEN r.other_n END AS form_n FROM v LEFT JOIN r ON r.word = v.word AND r.pick = 1),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n
FROM f JOIN t ON t.word = f.word JOIN f e ON e.word = t.root WHERE e.form IS NULL""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.spelling import count_words, letter_runs, skip_letters, spelling_groups

    return spelling_groups(count_words(skip_letters(letter_runs(table(spark, sf_dir, "documents")))))
