"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from episodica.llm import (
    chat,
    decontamination,
    fingerprints,
    importance,
    kneser_ney,
    language,
    lexical,
    packing,
    personal,
    secrets,
    simhash,
    toxicity,
    windows,
)
from episodica.llm.tables import table
from episodica.llm.tokens import vocabulary_path


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = chat.template(vocabulary_path())
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                ids, mask = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                formatted = batch.column(2)[k].as_py()
                turns = "".join(f"{role}\n{text}\n" for role, text in chat.parse(formatted))
                loss = "".join(held.masked_texts(ids, mask))
                out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), sha(turns), len(loss), sha(loss), len(formatted)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)

    formatted = chat.format_conversations(said.unionByName(more)).select("conv_id", "n_turns", "formatted", "token_ids", "loss_mask")
    return formatted.mapInArrow(digest, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return _digest(found, ("assign", "access", "hex"))


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(personal.find_personal(table(spark, sf_dir, "documents")), personal.KINDS)


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of each kind, the hash of the base spans and all spans as text."""

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = windows.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_lm_score, op2_language_id, op3_fingerprint, op4_chat_format, op5_toxicity, op6_simhash, op7_secrets, op8_personal,
        op9_decontamination, op10_packing, op11_importance, op12_windows, op13_search,
    )
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def _op4_sql() -> str:
    control = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in chat.CONTROLS).replace("'", "''")
    size = lambda x: f"length({x}) + len(regexp_extract_all({x}, '{control}'))"
    mine = "coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')"
    marks = len(chat.OPEN + chat.BODY + chat.CLOSE)
    text = "</s>[INST] ok [/INST]"
    return f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{text}'), (-1, 1, 'assistant', '{text}'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
      length({mine}) AS loss_chars, sha256({mine}) AS loss_sha256, CAST(sum({marks} + {size("r")} + {size("x")}) AS BIGINT) AS formatted_chars
    FROM said GROUP BY conv_id"""


def _op11_sql() -> str:
    """DuckDB has no crc32: the features that differ go through its bits, eight for each byte, lowest first."""
    lower = f"translate(text, '{importance.UPPER}', '{importance.LOWER}')"
    byte = "('0x' || substr(h, 2 * (i // 8) + 1, 2))::UBIGINT"
    bits = f"list_transform(range(4 * length(h)), lambda i: ({byte} >> (i % 8)) & 1)"
    crc = f"xor(list_reduce({bits}, lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1)), 4294967295::UBIGINT), 4294967295)"
    return f"""WITH both_ AS MATERIALIZED (SELECT row_number() OVER () AS r, kind, doc_id, regexp_extract_all({lower}, '{importance.WORD}') AS w
      FROM (SELECT 's' AS kind, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 't', NULL, coalesce(text, '') FROM benchmark)),
    each AS MATERIALIZED (SELECT r, kind, array_to_string(w[p : p + k - 1], ' ') AS feature FROM (SELECT r, kind, w, unnest(range(1, len(w) + 1)) AS p FROM both_), range(1, 4) AS runs(k)
      WHERE p + k - 1 <= len(w)),
    placed AS MATERIALIZED (SELECT feature, ({crc} % 10000)::INTEGER AS bucket FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM each))),
    counts AS (SELECT b AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range(10000) AS every(b) LEFT JOIN
      (SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM each JOIN placed USING (feature) GROUP BY bucket) ON b = bucket),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
    weights AS (SELECT r, sum(gain)::BIGINT AS weight, count(*) AS n_features FROM each JOIN placed USING (feature) JOIN gains USING (bucket) WHERE kind = 's' GROUP BY r),
    scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
      + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
      FROM both_ LEFT JOIN weights USING (r) WHERE kind = 's'),
    placed_ AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed_"""


def _op13_sql() -> str:
    words = f"regexp_extract_all(translate(text, '{importance.UPPER}', '{importance.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS t FROM documents WHERE text IS NOT NULL),
    sums AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM docs WHERE len(t) > 0),
    tfs AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
    weights AS (SELECT term, floor(1000 * ln((2 * max(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, sums GROUP BY term),
    asked AS (SELECT DISTINCT i, item_id, unnest({words}) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark WHERE text IS NOT NULL)),
    scored AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(t) * n) // l))))::BIGINT AS score
      FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN docs USING (r), sums GROUP BY i, item_id, r, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    found = {"op4_chat_format": _op4_sql(), "op11_importance": _op11_sql(), "op13_search": _op13_sql()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
