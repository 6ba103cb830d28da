"""The operators' queries over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe_replay, bwt_dedup, chat_format, decontaminate, html_extract, jaccard_join, language_id, license_scan, prefix_trie, quality_rules, spelling_variants, token_counts, warc
from tidewheel.llm.shared import pinned

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: A conversation whose texts are control strings; it checks that formatting is reversible.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = quality_rules.measured(table(spark, sf_dir, "documents"))
    measures = pinned(measures.select("row.doc_id", "lang", "source", *quality_rules.METRICS, "n_lines", "base_failed"))
    out = quality_rules.judged(measures, quality_rules.fences(quality_rules.sketches(measures)))
    return out.select("doc_id", *quality_rules.METRICS, "base_failed", "kept")


_OP5_SHARES = {"symbols": ("0.125", "20.0::DOUBLE"), "length": ("0.0625", "0.0::DOUBLE"), "dup_lines": ("1.0", "50.0::DOUBLE")}
_OP5_METRICS = (*_OP5_SHARES, "words")


def _op5_of(m: str) -> str:
    quartiles = ", ".join(f"coalesce(min(bucket) FILTER (metric = '{m}' AND 100 * up_to >= {p} * total), 0) AS {m}_{p}" for p in (25, 50, 75))
    return f"""coalesce(max(total) FILTER (metric = '{m}'), 0) AS {m}_n, coalesce(max(n_some) FILTER (metric = '{m}'), 0) AS {m}_some, {quartiles},
    coalesce(min(bucket) FILTER (metric = '{m}' AND bucket > 0 AND 2 * some_to >= n_some), 0) AS {m}_mid"""


def _op5_drawn(m: str, c: object) -> str:
    x, n = f"{m}_{c}", f"{m}_some" if c == "mid" else f"{m}_n"
    return f"(g.{n} * g.{x} + 50 * ((l.{n} * l.{x} + 50 * e.{x})::DOUBLE / (l.{n} + 50))) / (g.{n} + 50) AS {x}"


_OP5_AT = ", ".join(map(_op5_of, _OP5_METRICS))
_OP5_PICK = ", ".join(_op5_drawn(m, c) for m in _OP5_METRICS for c in (25, 50, 75, "mid"))
_OP5_BEYOND = " OR ".join(f"coalesce({m} > greatest({m}_75 + (3 * ({m}_75 - {m}_25) + {share}::DOUBLE * {m}_mid) * greatest(1.0::DOUBLE, sqrt(words_50 / greatest(n_words, 1))), {least}), false)" for m, (share, least) in _OP5_SHARES.items())


def _op5_quantiles(by: str) -> str:
    keys, over = (f"{by}, ", f"PARTITION BY {by}, metric") if by else ("", "PARTITION BY metric")
    return f"""SELECT {keys}{_OP5_AT} FROM (
    SELECT {keys}metric, bucket, sum(n) OVER ({over} ORDER BY bucket) AS up_to, sum(n) OVER ({over}) AS total,
      sum(CASE WHEN bucket > 0 THEN n ELSE 0 END) OVER ({over} ORDER BY bucket) AS some_to, sum(CASE WHEN bucket > 0 THEN n ELSE 0 END) OVER ({over}) AS n_some
    FROM (SELECT {keys}metric, bucket, CAST(sum(n) AS BIGINT) AS n FROM sketch GROUP BY ALL)
  ) {"GROUP BY " + by if by else ""}"""


OP5_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT rid, i, w[i:i + 4] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
), dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN rep USING (rid)
), r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(floor(1000 * n_symbols / greatest(word_chars, 1)) AS BIGINT) AS symbols,
    CAST(floor(100 * word_chars / greatest(n_words, 1)) AS BIGINT) AS length, CAST(floor(1000 * n_dup_lines / greatest(n_lines, 1)) AS BIGINT) AS dup_lines, n_words AS words
  FROM m
), long AS (
  SELECT lang, source, metric, v FROM (SELECT lang, source, unnest(['symbols', 'length', 'dup_lines', 'words']) AS metric, unnest([symbols, length, dup_lines, words]) AS v FROM r WHERE n_words > 0)
), sketch AS (
  SELECT lang, source, metric, (v >> s) << s AS bucket, count(*) AS n FROM (SELECT *, CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT) AS s FROM long) GROUP BY ALL
), g AS ({_op5_quantiles("lang, source")}), l AS ({_op5_quantiles("lang")}), e AS ({_op5_quantiles("")}),
fence AS (SELECT g.lang, g.source, {_OP5_PICK} FROM g LEFT JOIN l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_OP5_BEYOND}) AS kept
FROM r LEFT JOIN fence f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, w[i:i + size - 1] AS win
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, item_id, i, size FROM dw JOIN bw USING (win, size)),
n_hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""


def op7_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (language_id.fold(F.col("doc_id")) == 0).alias("held_out"))
    fitted = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs, fitted, keep=("doc_id", "held_out"))


def records(rows: DataFrame) -> DataFrame:
    """conv_id and ``record``: each conversation in one of three layouts, as sources of chats have them.

    A question and its answer are a prompt and a response; of the others, those of even id with none but the usual
    roles are turns "from" a human or gpt, and the rest are messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.col("t.role")
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    usual = (F.col("conv_id") % 2 == 0) & F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    name = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    layout = F.when(pair, "pair").when(F.coalesce(usual, F.lit(False)), "from").otherwise("messages")
    record = F.struct(
        F.when(F.col("l") == "pair", F.col("t")[0]["text"]).alias("prompt"),
        F.when(F.col("l") == "pair", F.get("t", F.lit(1))["text"]).alias("response"),
        F.when(F.col("l") == "from", F.transform("t", lambda x: F.struct(name(x["role"]).alias("from"), x["text"].alias("value")))).alias("conversations"),
        F.when(F.col("l") == "messages", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    )
    return own.withColumn("l", layout).select("conv_id", record.alias("record"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    turns = chat_format.turns_of_records(records(rows.unionByName(control)), "record")
    written = chat_format.format_chat(turns).select("conv_id", "formatted", "loss_mask")
    return chat_format.digests(chat_format.read_chat(written), "conv_id")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_end|>') + 2 + length(url_encode(role)) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.placed(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    conv = F.col("conv_id")
    own, ids = prefix_trie.borrowed(own, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)
    return prefix_trie.trie(own, ids)


#: The unsigned CRC-32 of a list of bytes ``{0}``, by the table ``crc.t`` of the 256 remainders of a byte.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b))"
_CRC = "xor(list_reduce(list_concat([4294967295], {0}), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295)"

OP11_SQL = rf"""
WITH {_CRC_TABLE},
o AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS l
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), h AS (
  SELECT conv_id, l, {_CRC.format("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")} % 4 AS h FROM o, crc
), r AS (
  SELECT h.conv_id, CASE WHEN h = 0 THEN h.l ELSE list_concat(coalesce(b.l[1:h], h.l[1:0]), h.l[h + 1:]) END AS l FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20
), p AS (SELECT conv_id, d, l[1:d] AS path FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].text, '[^ 	-
]+')) END AS saved
  FROM p GROUP BY d, path
), c AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT a.n AS n, n.path[1:a.n] AS path, n.saved, c.n IS NULL AS leaf FROM n LEFT JOIN c ON c.d = n.d AND c.path = n.path, unnest(range(0, n.d + 1)) AS a(n)),
s AS (SELECT n AS d, path, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM a GROUP BY ALL),
e AS (SELECT len(l) AS d, l AS path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM r GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.path = n.path LEFT JOIN c ON c.d = n.d AND c.path = n.path LEFT JOIN e ON e.d = n.d AND e.path = n.path
LEFT JOIN n u ON u.d = n.d - 1 AND u.path = n.path[1:n.d - 1]
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.labelled(license_scan.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op12_regex(elements: list) -> str:
    """A template as a regular expression over words that each follow a space."""
    out = ""
    for x in elements:
        if isinstance(x, bytes):
            out += " " + x.decode()
        elif isinstance(x, list):
            out += f"(?:{_op12_regex(x)})?"
        elif isinstance(x[0], list):
            out += "(?:" + "|".join(_op12_regex(w) for w in x) + ")"
        else:
            out += f"(?: [^ ]+){{{x[0]},{x[1]}}}"
    return out


_OP12_PHRASES = ", ".join(f"({[w.decode() for w in license_scan.split(p)]}, '{label}')" for p, label in license_scan.PHRASES.items())
_OP12_TEMPLATES = ", ".join(f"('{label}', '{' '.join(w.decode() for w in license_scan.anchor(e))}', '{_op12_regex(e)} ')" for label, e in ((label, license_scan.parsed(markup)) for label, markup in license_scan.TEMPLATES))
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w FROM documents),
p AS (SELECT * FROM (VALUES {_OP12_PHRASES}) v(phrase, label)),
t AS (SELECT * FROM (VALUES {_OP12_TEMPLATES}) v(label, words, regex)),  -- mandatory words first, for speed
b AS (SELECT rid, label, i - 1 AS i FROM (SELECT rid, w, label, phrase, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM d, p WHERE len(w) >= len(phrase)) WHERE w[i:i + len(phrase) - 1] = phrase),
m AS (SELECT DISTINCT rid, label FROM (SELECT rid, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d) x JOIN t ON contains(x.s, ' ' || t.words || ' ') WHERE regexp_matches(x.s, t.regex)),
bl AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels, count(*) AS n FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM m) GROUP BY rid),
ml AS (SELECT rid, count(*) AS n FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(bl.n, 0) AS n_base, bl.lo AS first_word, bl.hi AS last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CASE WHEN al.n IS NULL THEN 0.0::DOUBLE ELSE (al.n + coalesce(ml.n, 0)) / (2.0::DOUBLE * al.n) END AS score
FROM d LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN ml USING (rid)
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(table(spark, sf_dir, "documents"), spelt=spelling_variants.slipped)


_OP13_BYTES = "list_transform(range(0, length(hex(encode({0}))) // 2), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"
OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), o AS (SELECT doc, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY doc, run),
x AS (SELECT run, n, {_CRC.format(_OP13_BYTES.format("(doc || ':' || run)"))} AS h FROM o, crc),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM x)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), k AS (
  SELECT word, word AS key FROM v UNION SELECT word, substr(word, 1, i) || substr(word, i + 2) FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)
), p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word
  WHERE CASE WHEN length(a.word) = length(b.word) THEN len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1 ELSE a.key IN (a.word, b.word) END
),
f AS (SELECT a, count(*) AS n_near, min({{'m': -v.n, 'w': b}}) AS best FROM p JOIN v ON v.word = b GROUP BY a),
w AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.w END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM v LEFT JOIN f ON a = word),
c AS (SELECT word, word AS at FROM w UNION ALL SELECT c.word, w.form FROM c JOIN w ON w.word = c.at WHERE w.form IS NOT NULL)
SELECT w.word, w.n, w.form, CAST(w.form_n AS BIGINT) AS form_n, w.n_near, c.at AS root FROM w JOIN c ON c.word = w.word JOIN w e ON e.word = c.at WHERE e.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_token_counts": op3_token_counts,
        "op4_bwt_dedup": op4_bwt_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_decontaminate": op6_decontaminate,
        "op7_bpe_encode": op7_bpe_encode,
        "op8_warc": op8_warc,
        "op9_language_id": op9_language_id,
        "op10_chat_format": op10_chat_format,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_license_scan": op12_license_scan,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": OP2_SQL,
        "op5_quality_rules": OP5_SQL,
        "op6_decontaminate": OP6_SQL,
        "op10_chat_format": OP10_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_license_scan": OP12_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
