"""op4: all conversations formatted, and digests read back from the formatted text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.chat_format import format_conversations, parse_turns, unescape
from quillmere.llm.common import table

_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(parts: DataFrame) -> DataFrame:
    """One row a conversation from its parts, which lie in order in one partition."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def result() -> pa.RecordBatch:
            n_turns, turns, loss_chars, loss, chars = state
            values = [now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for rows in batches:
            for conv_id, part, formatted, begins, lengths in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
                if part == 0:
                    if state:
                        yield result()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = formatted.encode()
                for role, text in parse_turns(data):
                    state[0] += 1
                    state[1].update(role + b"\n" + text + b"\n")
                for begin, length in zip(begins, lengths, strict=True):
                    text = unescape(data[begin : begin + length])
                    state[2] += len(text.decode())
                    state[3].update(text)
                state[4] += len(formatted)
        if state:
            yield result()

    return parts.select("conv_id", "part", "formatted", "loss_begin", "loss_length").mapInArrow(digested, _SCHEMA)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return digest_conversations(format_conversations(turns))


QUERIES = {"op4_chat_formatting": op4_chat_formatting}
_ESCAPE = "replace(replace(replace(replace(replace({}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
ORACLE_SQL = {
    "op4_chat_formatting": f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    c AS (
      SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        CAST(sum(7 + 8 + 4 + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")})) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
    """,
}
