"""The queries of this subpackage: thin calls of the operators on the driver's tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT c.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id
"""


#: The rules that the pages are judged by.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.url_filter import filter_urls

    return filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import add_contamination

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = add_contamination(docs, _read(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    n_hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_OP3_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_OP3_WORDS}, []) AS ws FROM documents),
i AS (SELECT item_id, {_OP3_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS w
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
m AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.w = iw.w),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.ngram_join import near_duplicate_classes

    return near_duplicate_classes(_read(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(5, len(ws)) - 1], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.license_scan import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.license_scan import scan_notices

    return scan_notices(_read(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    from weftline.llm.license_scan import COPYRIGHT_LINE, NOT_WORD, SPELLINGS

    out = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', ' ', 'g'), '{NOT_WORD}', '  ', 'g')) || ' '"
    for said, meant in SPELLINGS:
        out = f"replace({out}, ' {said.replace(' ', '  ')} ', ' {meant.replace(' ', '  ')} ')"
    return f"replace(trim({out}), '  ', ' ')"


def _known_sql() -> str:
    from weftline.llm.license_scan import LICENSES

    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in LICENSES)
    return f"known AS (SELECT min(i) AS license_id, sha256({_canonical_sql('t')}) AS license_digest FROM (VALUES {rows}) v(i, t) GROUP BY 2)"


def _op5_sql() -> str:
    return f"""
WITH {_known_sql()}, d AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS license_digest FROM documents)
SELECT doc_id, license_digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN known USING (license_digest)
"""


def _notices_sql() -> str:
    return f"""
WITH {_known_sql()}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, CAST(line AS BIGINT) AS line, license_id FROM l JOIN known ON sha256({_canonical_sql('said')}) = license_digest
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.token_counts import count_document_tokens

    return count_document_tokens(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.langid import identify_languages, train_languages
    from weftline.llm.quality import held_out

    docs = _read(spark, sf_dir, "documents")
    found = identify_languages(docs.select("doc_id", "text"), train_languages(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x[i + 1])]), '') AS bits FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS keeper,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), '') AS payload_digest FROM b)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import held_out, score_quality, train_quality

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, _read(spark, sf_dir, "labels"))
    found = score_quality(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.vector_codes import compress

    found = compress(_read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op11_sql() -> str:
    """Two rounds of assignment and floored means, all distances of all parts to all entries."""

    def assigned(book: str) -> str:
        return f"""SELECT vec_id, p, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (
  SELECT x.vec_id, x.p, b.k, CAST(list_sum([(x.v[j] - b.v[j]) * (x.v[j] - b.v[j]) FOR j IN range(1, len(x.v) + 1)]) AS BIGINT) AS dist FROM x JOIN {book} b USING (p)) GROUP BY vec_id, p"""

    def moved(book: str, codes: str) -> str:
        return f"""SELECT b.p, b.k, CASE WHEN m.v IS NULL THEN b.v ELSE m.v END AS v FROM {book} b LEFT JOIN (
  SELECT p, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS v FROM (
    SELECT x.p, c.k, j, sum(x.v[j]) AS s, count(*) AS n FROM x JOIN {codes} c USING (vec_id, p), range(1, len(x.v) + 1) t(j) GROUP BY ALL) GROUP BY p, k) m USING (p, k)"""

    return f"""
WITH e AS (SELECT vec_id, label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM e, range(16) t(p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT p, k, v FROM x JOIN s USING (vec_id)),
c0 AS MATERIALIZED ({assigned("b0")}), b1 AS MATERIALIZED ({moved("b0", "c0")}),
c1 AS MATERIALIZED ({assigned("b1")}), b2 AS MATERIALIZED ({moved("b1", "c1")}),
c2 AS MATERIALIZED ({assigned("b2")}),
o AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM c2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
FROM o JOIN e USING (vec_id)
"""


#: Weights of the sources of the mixture, repeating in their order.
MIX_WEIGHTS = (5, 2, 1)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix, taken_words

    return taken_words(mix(_read(spark, sf_dir, "documents"), MIX_WEIGHTS))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight FROM s1),
-- sources in the order in which they reach three times their size: with the first c of them full, the level of the rest
s3 AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, place) AS c FROM s2),
s4 AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught,
              sum(weight) OVER (ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s3),
lv AS (SELECT (total - caught) / rest AS level FROM s4 WHERE (total - caught) / rest * weight <= cap ORDER BY c LIMIT 1),
s AS (SELECT source, place, source_size, least(cap, level * weight) AS target FROM s4, lv),
q AS (SELECT rid, doc_id, size, place, source_size, target, e AS epoch, ('0x' || substr(md5(concat_ws(':', '0', e, coalesce(CAST(doc_id AS VARCHAR), ''), size)), 1, 15))::BIGINT AS draw
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, range(3) t(e) WHERE e = 0 OR (source_size > 0 AND e < ceil(target / source_size))),
f AS (SELECT *, CAST(sum(size) OVER (PARTITION BY place ORDER BY epoch, draw, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin, CAST(floor(target) AS BIGINT) AS goal FROM q),
c AS (SELECT *, fin - size AS first, CASE WHEN fin - size < goal AND goal < fin THEN goal ELSE fin END AS last FROM f
      UNION ALL SELECT *, goal AS first, fin AS last FROM f WHERE fin - size < goal AND goal < fin),
o AS (SELECT *, CAST(sum(last - first) OVER (ORDER BY CASE WHEN target > 0 THEN last / target ELSE 0 END, place, last, epoch, draw, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS past FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(last - first, (SELECT sum(size) FROM d) - (past - (last - first))))) AS BIGINT) AS taken
FROM o GROUP BY rid, doc_id, size, source_size, target
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.collocations import collocations

    return collocations(_read(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
       SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
f AS MATERIALIZED (SELECT lang, k, string_split(ph, ' ') AS ph, f FROM (
       SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS ph, count(*) AS f
       FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(ws) >= k) GROUP BY ALL HAVING count(*) >= 100)),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.ph, c.f AS a, l.f AS l, r.f AS r, t.n, j, CAST(1000 * c.f::HUGEINT * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:j] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[j + 1:] JOIN t ON t.lang = c.lang),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
g AS (SELECT DISTINCT lang, ph[i:j] AS ph, f FROM c, range(1, 6) t(i), range(1, 6) u(j) WHERE i <= j AND j <= k AND j - i + 1 < k),
kept AS (SELECT w.* FROM w LEFT JOIN (SELECT lang, ph, max(f) AS f FROM g GROUP BY lang, ph) g USING (lang, ph) WHERE g.f IS NULL OR 100 * g.f < 100 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(ph, ' '))) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_url_filter": op2_url_filter,
        "op3_decontaminate": op3_decontaminate,
        "op4_ngram_join": op4_ngram_join,
        "op5_license_scan": op5_license_scan,
        "license_notices": license_notices,
        "op6_token_counts": op6_token_counts,
        "op7_packing": op7_packing,
        "op8_language_id": op8_language_id,
        "op9_warc": op9_warc,
        "op10_quality": op10_quality,
        "op11_vector_codes": op11_vector_codes,
        "op12_mixing": op12_mixing,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": OP1_SQL,
        "op3_decontaminate": OP3_SQL,
        "op4_ngram_join": OP4_SQL,
        "op5_license_scan": _op5_sql(),
        "license_notices": _notices_sql(),
        "op9_warc": OP9_SQL,
        "op11_vector_codes": _op11_sql(),
        "op12_mixing": OP12_SQL,
        "op13_collocations": OP13_SQL,
    }
