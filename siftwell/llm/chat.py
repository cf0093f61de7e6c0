"""Chat formatting: snapshots of a growing conversation collapse into the longest, which is then rendered.

A logger that writes a conversation after every exchange leaves many conversations that are prefixes of later ones. Each
conversation is read once in order of its turns while a digest rolls along: after every turn it stands for the whole
prefix up to there. A conversation whose last digest is one of the digests of a longer conversation is a snapshot of
it, and an anti-join removes it. Equal conversations meet at their last digest, and the one with the smallest id stays.
Only maximal conversations are rendered.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import ship
from siftwell.storage import staged

# Fixed text: how a turn is written.
TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|", "|>\n", "\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1) and digest of every turn-prefix of every conversation.

    Turns are ordered by turn, null first, then by role and text; null parts differ from empty ones. A task reads its
    conversations turn by turn and holds no more than one digest, however long they are.
    """
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rolling, place, begun = None, hashlib.blake2b(digest_size=16), 0, False
        for batch in batches:
            ids, places, digests = batch.column("conv_id").to_pylist(), [], []
            for conv, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if not begun or conv != current:
                    current, rolling, place, begun = conv, hashlib.blake2b(digest_size=16), 0, True
                for part in (role, text):
                    # Lengths before the parts keep their bounds.
                    raw = b"" if part is None else part.encode()
                    rolling.update((-1 if part is None else len(raw)).to_bytes(8, "little", signed=True) + raw)
                place += 1
                places.append(place)
                digests.append(rolling.digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(digests, pa.binary())], ["conv_id", "place", "digest"]
            )

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, place long, digest binary")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that neither equal one with a smaller id nor begin a longer one.

    `turns` has conv_id, turn, role and text; other columns play no part. Rows without a conv_id belong to no
    conversation and are left out. Repeated turns count as turns. An empty table has no conversations.
    """
    # Read by every branch below, so written once.
    steps = staged(prefixes(_turns(turns)))
    length = steps.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    ends = steps.join(length.hint("merge"), "conv_id").where("place = n_turns").select("conv_id", "n_turns", "digest")
    firsts = ends.groupBy("digest", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    inner = steps.join(length.hint("merge"), "conv_id").where("place < n_turns").select("digest", "place").distinct()
    inside = (firsts["digest"] == inner["digest"]) & (firsts["n_turns"] == inner["place"])
    return firsts.join(inner.hint("merge"), inside, "left_anti").select("conv_id", "n_turns")


def _turns(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", "role", "text")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), F.coalesce(role, F.lit("")), F.lit(ROLE_CLOSE), F.coalesce(text, F.lit("")), F.lit(TURN_CLOSE))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of every maximal conversation; null roles and texts are written as empty ones.

    A row of the result is one whole conversation, so its text is as long as its turns together.
    """
    kept = maximal(turns)
    parts = _turns(turns).join(kept.hint("merge"), "conv_id")
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    chats = parts.groupBy("conv_id", "n_turns").agg(listed.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: _rendered(t["role"], t["text"])), "")
    return chats.select("conv_id", "n_turns", text.alias("text"))


def report(turns: DataFrame) -> DataFrame:
    return format_chats(turns)


#: The same in the SQL of DuckDB.
REPORT_SQL = """
WITH c AS (SELECT conv_id, count(*) AS n_turns,
  list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT turns[:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
f AS (SELECT min(conv_id) AS conv_id, n_turns, turns FROM c GROUP BY n_turns, turns)
SELECT conv_id, n_turns,
  array_to_string(list_transform(turns, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10)), '') AS text
FROM f WHERE turns NOT IN (SELECT turns FROM p)"""
