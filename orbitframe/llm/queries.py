"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orbitframe.llm import (
    chat, collocations, decontaminate, html_text, importance, license_scan,
    packing, simhash, suffix_dedup, token_counts, topk, toxicity, warc)
from orbitframe.llm.common import saved, scratch, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), scratch(spark), TOKENIZER)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state or consist of."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return toxicity.toxicity_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; an archive with a gap is an error."""
    folder = scratch(spark)
    pages = table(spark, sf_dir, "pages")
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, "
                                         "record_type string, refers_to long")
    warc.write_warc(pages, folder)
    number = lambda name: F.regexp_extract(
        F.col("headers")[name], "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    records = saved(warc.read_warc(spark, folder, warc.OWN_RECORD).select(
        "kind", "file", "offset", "reason", number("warc-record-id").alias("page_id"), F.col("headers")["warc-type"].alias("record_type"),
        number("warc-refers-to").alias("refers_to"), "payload_digest",
        F.length("payload").cast("long").alias("payload_bytes")))
    lost = records.where("kind = 'gap'").select("file", "offset", "reason").first()
    if lost:
        raise RuntimeError(f"{lost.file} cannot be read back from byte {lost.offset} on: {lost.reason}")
    first = records.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest").agg(
            F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(
        first, ["refers_to", "payload_digest"], "left")
    return records.where("record_type = 'response'").unionByName(revisits).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that come earlier."""
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def chat_events(conversations: DataFrame, delta_chars: int = 200) -> DataFrame:
    """The log behind finished conversations: drafts that are thrown away, then streamed text.

    A user's draft is edited away, any other role's is regenerated. Rows of one turn are messages
    each, in order of (role, text); a null turn comes first.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(role, text))
    rows = conversations.select(
        F.col("conv_id").cast("long"), (F.shiftleft(F.coalesce(F.col("turn").cast("long"), F.lit(-1)), 24)
                                        + nth).alias("message"), role.alias("role"), text.alias("text"))
    event = lambda kind, text, role=F.lit(None).cast("string"): F.struct(
        F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("text") / delta_chars).cast("int")),
        lambda i: event("delta", F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars))))
    draft = F.reverse("text")
    dropped = F.when(F.col("role") == "user", F.array(
        event("start", draft, F.col("role")), event("edit", F.lit("")))).otherwise(F.array(
            event("start", F.lit(""), F.col("role")), event("delta", draft),
            event("regenerate", F.lit(None).cast("string"))))
    return rows.select("conv_id", "message", F.posexplode(F.concat(dropped, pieces)).alias("seq", "e")
                       ).select("conv_id", "message", "seq", "e.kind", "e.role", "e.text")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts imitate the template, rebuilt and rendered."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mimic = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", mimic), (-7, 1, "assistant", mimic)], own.schema)
    messages = chat.fold_events(chat_events(own.unionByName(extra)))
    return chat.read_back(chat.render(messages))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences."""
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), TOKENIZER))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    vectors = saved(topk.integer_vectors(table(spark, sf_dir, "embeddings")))
    return topk.exact_top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the alignment."""
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language with the highest scores."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the benchmark, and the tenth that is drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
                               ).select("doc_id", "n_features", "weight", "score", "rank")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_suffix_array": op5_suffix_array,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_best_fit": op8_best_fit,
    "op9_top_k": op9_top_k,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_importance": op12_importance,
    "op13_html_text": op13_html_text,
}
SQL: dict[str, str] = {
    "op2_license_scan": license_scan.scan_sql(),
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n,
                          sha1(encode(coalesce(html, ''))) AS h FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(
                       h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)),
                   '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END
                   AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
    "op7_chat": """
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn))
                   AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT)
                   AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
                                 ORDER BY turn)) AS loss_sha256,
               CAST(sum(14 + length(regexp_replace(role, '[\\\\#<:]', 'xx', 'g'))
                        + length(regexp_replace(text, '[\\\\#<]', 'xx', 'g'))) AS BIGINT)
                   AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM s) WHERE rank <= 5""",
    "op11_collocations": r"""
        WITH pieces AS (SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS part FROM (
            SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
        words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'),
                                           lambda w: w <> '') AS w FROM pieces),
        counts AS (SELECT lang, m, phrase, count(*) AS f FROM (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2),
                       lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
            FROM words, (SELECT unnest([1, 2, 3, 4]) AS m)) GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
        known AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30),
        cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS one,
                        array_to_string(w[k + 1:], ' ') AS two
                 FROM known, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
        scored AS (SELECT c.*, x.f AS l, y.f AS r,
                          CAST(2000000 * c.a::HUGEINT // (x.f::HUGEINT + y.f) AS BIGINT) AS score
                   FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = one
                               JOIN known y ON y.lang = c.lang AND y.phrase = two),
        best AS (SELECT * FROM scored
                 QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longest
                   FROM known, (SELECT unnest([2, 3]) AS s), (SELECT unnest([1, 2, 3]) AS i)
                   WHERE s < m AND i + s - 1 <= m GROUP BY ALL)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)
                   AS rank, b.phrase, a, l, r, n, score
        FROM best b JOIN totals t ON t.lang = b.lang
             LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
        WHERE longest IS NULL OR 100 * longest::HUGEINT < 80 * a::HUGEINT
        QUALIFY rank <= 2000""",
    "op12_importance": r"""
        WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k:
                       CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
            FROM range(256) AS r(i))),
        texts AS (SELECT row_number() OVER () AS row, doc_id, true AS own, text FROM documents
                  UNION ALL SELECT NULL, NULL, false, text FROM benchmark),
        words AS (SELECT row, doc_id, own, unnest(regexp_extract_all(translate(
            text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
        known AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
                      list_transform(range(octet_length(encode(w))), lambda i:
                          CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
                      lambda c, b: xor(t[CAST(1 + (xor(c, b) & 255) AS BIGINT)], c >> 8))) % 10000 AS bucket
                  FROM (SELECT DISTINCT w FROM words), steps),
        hashed AS (SELECT row, own, bucket FROM words JOIN known USING (w)),
        counts AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t
                   FROM hashed GROUP BY bucket),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE
                      * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE
                      * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
        weights AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
                    FROM hashed JOIN gains USING (bucket) WHERE own GROUP BY row),
        scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
                              '2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                              / 4294967296::DOUBLE))) AS BIGINT) AS score
                   FROM texts LEFT JOIN weights USING (row) WHERE own),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20
                             ORDER BY score DESC, doc_id NULLS LAST) AS place,
                          count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND place <= 10 * total // 100 THEN place END AS rank
        FROM placed""",
}
