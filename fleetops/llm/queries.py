"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.llm import langid, quality_crf, token_counts
from fleetops.llm.common import table
from fleetops.llm.decontaminate import contamination
from fleetops.llm.divergence import divergence
from fleetops.llm.licenses import TEMPLATES, license_scan
from fleetops.llm.mixing import mix
from fleetops.llm.quality_rules import quality_rules
from fleetops.llm.sharding import shard
from fleetops.llm.simhash import near_dedup
from fleetops.llm.spelling import spelling_variants, vocabulary
from fleetops.llm.suffix_dedup import suffix_dedup
from fleetops.llm.tree_weighting import score


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the line CRF; learned from labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.remainder(F.col("doc_id"), 3) == 1
    model = quality_crf.fit(docs, labels.filter(~held_out))
    found = quality_crf.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, linked at two differing bits."""
    out = near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), bits=2, columns=["doc_id"])
    return out.select("doc_id", "fingerprint", "component_id", "is_first")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson copies of every document: a source's share is the square root of its rows."""
    out = mix(table(spark, sf_dir, "documents"), alpha=0.5, seed=42)
    return out.select("doc_id", "source", "copies", "copy_no", "mix_key", F.octet_length("text").cast("long").alias("n_bytes"))


OP3_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, n, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
w AS (SELECT source, greatest(1, ceil(rate / 32))::int AS draws, rate / greatest(1, ceil(rate / 32)) AS mean FROM r),
p AS (SELECT source, k, exp(-mean) * pow(mean, k) / gamma(k + 1) AS p FROM w, generate_series(0, 160) AS g(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT row_number() OVER () AS rid, doc_id, documents.source, text, draws, concat_ws(chr(31), '42', coalesce(doc_id::varchar, ''), md5(coalesce(text, ''))) AS id
  FROM documents JOIN w ON w.source IS NOT DISTINCT FROM documents.source),
u AS (SELECT d.*, ('0x' || substr(md5(concat_ws(chr(31), id, 'draw', draw::varchar)), 1, 13))::bigint / 4503599627370496.0 AS u FROM d, generate_series(1, draws) AS g(draw)),
m AS (SELECT u.rid, u.doc_id, u.source, u.text, u.id, count(*) AS copies FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY ALL)
SELECT doc_id, source, copies::int AS copies, copy_no::int AS copy_no,
  ('0x' || substr(md5(concat_ws(chr(31), id, 'order', copy_no::varchar)), 1, 15))::bigint AS mix_key,
  coalesce(strlen(text), NULL)::bigint AS n_bytes
FROM m, generate_series(1, m.copies) AS g(copy_no)
"""


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law `rows`."""
    out = shard(table(spark, sf_dir, "documents"), n_shards=24, seed=42)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 by its table of 256 entries; a row's place in its bucket by row number and the bucket's swaps.
OP4_SQL = """
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
p AS (SELECT doc_id, text, coalesce(strlen(text), 0) AS len, md5('42|' || coalesce(md5(doc_id::varchar), 'n') || coalesce(md5(text), 'n') || coalesce(md5(lang), 'n') || coalesce(md5(source), 'n') || coalesce(md5(n_chars::varchar), 'n')) AS row_h FROM documents),
s AS (SELECT *, md5(row_h || '|' || (row_number() OVER (PARTITION BY row_h) - 1)::varchar) AS h, count(*) OVER () AS n, greatest(1, ceil(sum(len + 64) OVER () / 16777216.0)::bigint, ceil(count(*) OVER () / 2000.0)::bigint) AS buckets FROM p),
b AS (SELECT *, ('0x' || substr(h, 1, 15))::bigint % buckets AS bucket FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h) AS i FROM b),
c AS (SELECT bucket, count(*) AS m, coalesce(sum(count(*)) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM b GROUP BY bucket),
y AS (SELECT bucket, before, list_reduce(list_prepend(range(m), list_transform(range(m - 1, 0, -1), lambda i: [i, ('0x' || substr(md5('42|' || bucket::varchar || '|' || i::varchar), 1, 15))::bigint % (i + 1)])),
  lambda a, x: CASE WHEN x[1] = x[2] THEN a ELSE a[:x[2]] || [a[x[1] + 1]] || a[x[2] + 2:x[1]] || [a[x[2] + 1]] || a[x[1] + 2:] END) AS places FROM c),
o AS (SELECT doc_id, text, len, n, before + places[i] AS pos FROM i JOIN y USING (bucket)),
q AS (SELECT *, (pos * 24 // n)::int AS shard FROM o),
bytes AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) AS b FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
crc AS (SELECT text, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, tab)
SELECT doc_id, (len + 8)::bigint AS size, crc.crc::bigint AS text_crc32, 'rows' AS law, shard, (pos - (shard * n + 23) // 24)::bigint AS slot, NULL::int AS grown_shard
FROM q JOIN crc ON crc.text = coalesce(q.text, '')
"""


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token length histogram of all documents with its suffix sums at every length."""
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the byte CNN; learned from documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held_out = langid.remainder(F.col("doc_id"), 4) == 2
    net = langid.fit(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in every document, with containment and the best window."""
    return license_scan(table(spark, sf_dir, "documents"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Windows of twice a template's size class by number, from the places of its shingles; all that hold 0.8 of them.
OP7_SQL = f"""
WITH t(template, text) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(TEMPLATES.items()))}),
tw AS (SELECT template, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM t),
ts AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT template, count(*) AS n, pow(2, ceil(log2(1.25 * count(*))))::bigint AS c FROM ts GROUP BY template),
dw AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
ds AS (SELECT rid, doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
h AS (SELECT rid, doc_id, template, n, c, s, unnest([i // c, i // c - 1]) AS k FROM ds JOIN ts USING (s) JOIN tn USING (template)),
x AS (SELECT rid, any_value(doc_id) AS doc_id, template, k, any_value(c) AS c, count(DISTINCT s) / any_value(n)::double AS containment FROM h WHERE k >= 0 GROUP BY rid, template, k HAVING count(DISTINCT s) / any_value(n)::double >= 0.8)
SELECT any_value(doc_id) AS doc_id, template, max(containment) AS containment, min(CASE WHEN containment = most THEN k * c END)::int AS first_word, (2 * any_value(c) + 4)::int AS n_words, count(*) AS n_windows
FROM (SELECT *, max(containment) OVER (PARTITION BY rid, template) AS most FROM x) GROUP BY rid, template
"""


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document and the verdict of the weighed rules."""
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_posterior"
    )


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item held by every document, with score and overlaps."""
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = out.select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.at_word", F.round("m.score", 6).alias("score"), "m.containment", "m.question_overlap", "m.answer_overlap")


#: All passages (two segments each) that hold 0.8 of an item's shingles, scored, and of each document's the best.
OP9_SQL = r"""
WITH i0 AS (SELECT row_number() OVER () AS iid, item_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
i AS (SELECT * FROM i0 WHERE len(w) > 0),
st AS (SELECT count(*)::double AS n, avg(len(w)) AS mean, greatest(5, max(len(w)) + max(len(w)) // 4) AS span FROM i),
ip AS (SELECT iid, w, least(5, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM i),
ish AS (SELECT DISTINCT iid, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM ip),
isz AS (SELECT iid, count(*) AS n_s FROM ish GROUP BY iid),
it AS (SELECT iid, t, count(*)::double AS f FROM (SELECT iid, unnest(w) AS t FROM i) GROUP BY ALL),
df AS (SELECT t, count(*)::double AS df FROM it GROUP BY t),
im AS (SELECT it.iid, it.t, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) AS impact FROM it JOIN df USING (t) JOIN i USING (iid), st),
ia AS (SELECT iid, CASE WHEN contains(text, chr(10)) THEN regexp_extract(text, '^([\s\S]*)\n', 1) ELSE text END AS q, CASE WHEN contains(text, chr(10)) THEN regexp_extract(text, '([^\n]*)$', 1) ELSE '' END AS a FROM i),
iq AS (SELECT DISTINCT iid, unnest(regexp_extract_all(lower(q), '[\p{L}\p{N}_]+')) AS t FROM ia),
ian AS (SELECT DISTINCT iid, unnest(regexp_extract_all(lower(a), '[\p{L}\p{N}_]+')) AS t FROM ia),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM ish),
dp AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
hit AS (SELECT rid, iid, s, p - 1 AS pos, k FROM (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM dp) JOIN ish USING (k, s)),
pas AS (SELECT rid, iid, s, unnest([pos // span, pos // span - 1]) AS seg, pos, k, span FROM hit, st),
con AS (SELECT rid, iid, seg, any_value(span) AS span, count(DISTINCT s) AS shared FROM pas WHERE seg >= 0 AND pos + k <= (seg + 2) * span GROUP BY rid, iid, seg),
c AS (SELECT con.*, shared / n_s::double AS containment FROM con JOIN isz USING (iid) WHERE shared / n_s::double >= 0.8 - 1e-9),
pt AS (SELECT DISTINCT c.rid, c.seg, unnest(w[c.seg * span + 1:(c.seg + 2) * span]) AS t FROM (SELECT DISTINCT rid, seg, span FROM c) c JOIN d USING (rid)),
sc AS (SELECT c.rid, c.iid, c.seg, sum(impact) AS score FROM c JOIN pt USING (rid, seg) JOIN im ON im.iid = c.iid AND im.t = pt.t GROUP BY ALL),
qo AS (SELECT c.rid, c.iid, c.seg, count(pt.t) / count(*)::double AS o FROM c JOIN iq USING (iid) LEFT JOIN pt ON pt.rid = c.rid AND pt.seg = c.seg AND pt.t = iq.t GROUP BY ALL),
ao AS (SELECT c.rid, c.iid, c.seg, count(pt.t) / count(*)::double AS o FROM c JOIN ian USING (iid) LEFT JOIN pt ON pt.rid = c.rid AND pt.seg = c.seg AND pt.t = ian.t GROUP BY ALL),
m AS (SELECT rid, iid, seg, span, containment, score, coalesce(qo.o, 1) AS q, coalesce(ao.o, 1) AS a FROM c JOIN sc USING (rid, iid, seg) LEFT JOIN qo USING (rid, iid, seg) LEFT JOIN ao USING (rid, iid, seg))
SELECT doc_id, item_id, (seg * span)::bigint AS at_word, round(score, 6) AS score, containment, q AS question_overlap, a AS answer_overlap
FROM m JOIN d USING (rid) JOIN i USING (iid) WHERE q >= 0.5 AND a >= 0.5 QUALIFY row_number() OVER (PARTITION BY rid, iid ORDER BY containment DESC, round(score, 9) DESC, seg) = 1
"""


def op10_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left when strings of 200 bytes that occur elsewhere are removed."""
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: All windows of 200 bytes as hex digits, cut out of two neighbouring pieces of 200 bytes, known by two hashes.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT rid, q, y[q] || coalesce(y[q + 1], '') AS two FROM (SELECT rid, y, unnest(range(1, len(y) + 1)) AS q FROM (SELECT rid, regexp_extract_all(x, '.{1,400}') AS y FROM d))),
w AS (SELECT rid, 200 * (q - 1) + o AS i, substr(two, 2 * o - 1, 400) AS s FROM (SELECT *, unnest(range(1, 201)) AS o FROM c) WHERE strlen(two) >= 2 * o + 398),
h AS (SELECT rid, i, hash(s) AS h, hash(left(s, 200)) AS k FROM w),
r AS (SELECT rid, i FROM h SEMI JOIN (SELECT h, k FROM h GROUP BY h, k HAVING count(*) > 1) t ON h.h = t.h AND h.k = t.k),
g AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT rid, min(i) AS a, max(i) + 199 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM g) GROUP BY rid, run),
k AS (SELECT rid, count(*) AS n_spans, sum(z - a + 1) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM s GROUP BY rid),
p AS (SELECT d.rid, doc_id, x, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, coalesce(list_concat([0], ends), [0]) AS lo, coalesce(list_concat(starts, [strlen(x) // 2 + 1]), [strlen(x) // 2 + 1]) AS hi FROM d LEFT JOIN k ON k.rid = d.rid)
SELECT doc_id, (strlen(x) // 2)::bigint AS n_bytes, n_removed::bigint AS n_removed, n_spans::bigint AS n_spans,
  sha256(from_hex(array_to_string(list_transform(range(1, len(lo) + 1), lambda j: substr(x, 2 * lo[j] + 1, 2 * (hi[j] - lo[j] - 1))), ''))) AS kept_sha256 FROM p
"""


def op11_pointer_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the sources of each language are, and the ten terms that mark each of them."""
    return divergence(table(spark, sf_dir, "documents"), min_docs=10, top=10)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::hugeint AS n FROM t GROUP BY lang, term HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(t.n)::hugeint AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(term)::hugeint AS v, coalesce(sum(n), 0)::hugeint AS total FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
s AS (SELECT g.lang, g.source, v.v, v.total AS lang_total, coalesce(sum(c.n), 0)::hugeint AS total FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (s.total + 2 * v) AS p, 1 + 1000000000 * (k.n + 2) // (lang_total + 2 * v) AS q FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
a AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(a.value, 0)::bigint AS value FROM g JOIN g AS o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::bigint AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""


def op12_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots; one run of 97 counts with a planted mistake."""
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents"), least=5, times=3, every=97))


#: CRC-32 by its table; near words by what is left without one code point, at the same place or as another word.
OP12_SQL = """
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
r AS (SELECT id, w, count(*) AS c FROM d WHERE length(w) >= 5 GROUP BY id, w),
b AS (SELECT w, c, list_transform(regexp_extract_all(hex(encode(id || ':' || w)), '..'), lambda x: ('0x' || x)::bigint) AS b FROM r),
h AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
m AS (SELECT c, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w FROM h),
v AS MATERIALIZED (SELECT w, sum(c)::bigint AS n FROM m WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
g AS MATERIALIZED (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS k FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM v)),
p AS (SELECT a.w, b.w AS o FROM g AS a JOIN g AS b ON a.k = b.k AND a.i = b.i AND a.w <> b.w UNION SELECT g.w, v.w FROM g JOIN v ON v.w = g.k UNION SELECT v.w, g.w FROM g JOIN v ON v.w = g.k),
f AS MATERIALIZED (SELECT w, n, n_near, CASE WHEN best.n >= 2 * n THEN best.w END AS form, CASE WHEN best.n >= 2 * n THEN best.n END AS form_n
  FROM v LEFT JOIN (SELECT p.w AS of, count(*) AS n_near, arg_min({'w': v.w, 'n': v.n}, (-v.n, v.w)) AS best FROM p JOIN v ON v.w = p.o GROUP BY p.w) ON of = w),
up AS (SELECT w, w AS root, form AS next FROM f UNION ALL SELECT up.w, f.w, f.form FROM up JOIN f ON f.w = up.next)
SELECT f.w AS word, form, root, n, coalesce(n_near, 0)::bigint AS n_near, form_n FROM f JOIN up ON up.w = f.w WHERE up.next IS NULL
"""


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by context-tree weighting, and by add-one counts of tokens; learned from
    documents outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    found = score(docs, ~held_out, ["doc_id"])
    return found.select("doc_id", (~F.col("_trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf": op1_line_crf,
    "op2_simhash": op2_simhash,
    "op3_source_mixing": op3_source_mixing,
    "op4_two_pass_shuffle": op4_two_pass_shuffle,
    "op5_length_histogram": op5_length_histogram,
    "op6_byte_cnn": op6_byte_cnn,
    "op7_license_minhash": op7_license_minhash,
    "op8_weak_supervision": op8_weak_supervision,
    "op9_bm25_decontamination": op9_bm25_decontamination,
    "op10_prefix_free_parsing": op10_prefix_free_parsing,
    "op11_pointer_sort": op11_pointer_sort,
    "op12_reduced_alphabet": op12_reduced_alphabet,
    "op13_context_tree": op13_context_tree,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": OP3_SQL,
    "op4_two_pass_shuffle": OP4_SQL,
    "op7_license_minhash": OP7_SQL,
    "op9_bm25_decontamination": OP9_SQL,
    "op10_prefix_free_parsing": OP10_SQL,
    "op11_pointer_sort": OP11_SQL,
    "op12_reduced_alphabet": OP12_SQL,
}
