"""Conversations as token ids with a loss mask (operator 9).

The template, where the capitals stand for reserved ids above the tokenizer's vocabulary:

    user                 INST_OPEN text INST_CLOSE
    assistant            text EOS
    system               SYS_OPEN text SYS_CLOSE
    any other role       ROLE_OPEN role ROLE_CLOSE text EOS

Texts are encoded segment by segment and the reserved ids are spliced in between, so no text can
produce one. As the rendered form shows reserved ids by their control strings, a control string inside a
text is escaped: every backslash is doubled, and a single backslash is put behind the first character of
every control string. Dropping single backslashes and halving doubled ones undoes it.

The loss falls on the text of assistants, not on the end mark. Segment lengths give spans by prefix sums:
inside a turn over its segments, and over the turns of a conversation. The output has a row per turn, since
one conversation may hold a third of all turns: its stream is its rows in order of ``start``.

A null text is empty, a null role is the empty role, a null conv_id is a conversation of its own. Turns with
the same number (null comes first) follow each other by role, by the first 64 characters of their text and by its digest;
repeated rows stay repeated.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import cut, lists, map_batches, tasks
from tomewise.llm.token_files import encoder
from tomewise.operators.ordering import in_ranges, running_total

# Reserved ids count up from the size of the vocabulary, in this order.
CONTROLS = ("[INST]", "[/INST]", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
INST_OPEN, INST_CLOSE, EOS, SYS_OPEN, SYS_CLOSE, ROLE_OPEN, ROLE_CLOSE = range(len(CONTROLS))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")

FORMATTED = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, ids ARRAY<INT>, loss_from INT, loss_to INT, n_ids INT, n_chars BIGINT"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _segments(role: str, text: str) -> list[int | str]:
    """A turn as reserved marks and texts."""
    match role:
        case "user":
            return [INST_OPEN, text, INST_CLOSE]
        case "assistant":
            return [text, EOS]
        case "system":
            return [SYS_OPEN, text, SYS_CLOSE]
    return [ROLE_OPEN, role, ROLE_CLOSE, text, EOS]


def _turn_encoder(tokenizer: str):
    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        base = code.tokenizer.get_vocab_size()
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            roles = part.column(2).fill_null("").to_pylist()
            texts = part.column(3).fill_null("").to_pylist()
            turns = [[escape(s) if isinstance(s, str) else s for s in _segments(*t)] for t in zip(roles, texts)]
            said = [s for turn in turns for s in turn if isinstance(s, str)]
            coded = iter([np.frombuffer(b, code.dtype).astype(np.int32) for b in code(said)])
            ids, sizes, spans, chars = [], [], [], []
            for role, turn in zip(roles, turns):
                parts = [next(coded) if isinstance(s, str) else np.array([base + s], np.int32) for s in turn]
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                loss = 0 if role == "assistant" else None
                spans.append((bounds[loss], bounds[loss + 1]) if loss is not None else (0, 0))
                ids += parts
                sizes.append(bounds[-1])
                chars.append(sum(len(s if isinstance(s, str) else CONTROLS[s]) for s in turn))
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(roles, pa.string()),
                    pa.array(texts, pa.string()),
                    lists(flat, np.concatenate([[0], np.cumsum(sizes)])),
                    pa.array([s[0] for s in spans], pa.int32()),
                    pa.array([s[1] for s in spans], pa.int32()),
                    pa.array(sizes, pa.int32()),
                    pa.array(chars, pa.int64()),
                ],
                names=["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to", "n_ids", "n_chars"],
            )

    return encode


def _starts(coded: DataFrame) -> DataFrame:
    """(row, start): the ids before each turn in its conversation. Running totals over ranges of narrow rows, so that no
    conversation has to fit into a task."""
    narrow = coded.select(
        "conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), F.sha2("text", 256).alias("digest"), "row", "n_ids"
    )
    order = ["conv_id", "turn", "role", "head", "digest", "row"]
    upto = running_total(in_ranges(narrow, order), order, "n_ids", "upto")
    before = cut(upto.select("conv_id", "row", (F.col("upto") - F.col("n_ids")).alias("before")))
    first = before.groupBy("conv_id").agg(F.min("before").alias("first")).withColumnRenamed("conv_id", "conv")
    joined = before.join(first, F.col("conv_id").eqNullSafe(F.col("conv")))
    return joined.select("row", (F.col("before") - F.col("first")).alias("start"))


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, start, ids, loss_from, loss_to, n_chars) per turn of ``turns (conv_id, turn, role,
    text)``: where the turn starts in the conversation's stream, its ids, and the span of ids, counted
    from the start of the conversation, that the loss falls on."""
    turns = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    coded = map_batches(turns, _turn_encoder(tokenizer), FORMATTED)
    # Numbers that hold once they are written; the ids stay where they are while the starts are found.
    coded = cut(coded.withColumn("row", F.monotonically_increasing_id()))
    return coded.join(_starts(coded), "row").select(
        "conv_id",
        "start",
        "ids",
        (F.col("start") + F.col("loss_from")).alias("loss_from"),
        (F.col("start") + F.col("loss_to")).alias("loss_to"),
        "n_chars",
    )


def _parse(ids: np.ndarray, loss: tuple[int, int], tokenizer, base: int) -> tuple[str, str, str]:
    """Role, text and loss text of a turn, from its ids alone."""

    def said(part: np.ndarray) -> str:
        return unescape(tokenizer.decode(part.tolist(), skip_special_tokens=False))

    marks = np.flatnonzero(ids >= base)
    masked = said(ids[loss[0] : loss[1]])
    match int(ids[0]) - base:
        case 0:  # INST_OPEN
            role, body = "user", ids[1 : marks[1]]
        case 3:  # SYS_OPEN
            role, body = "system", ids[1 : marks[1]]
        case 5:  # ROLE_OPEN
            role, body = said(ids[1 : marks[1]]), ids[marks[1] + 1 : marks[2]]
        case _:
            role, body = "assistant", ids[: marks[0]]
    return role, said(body), masked


DIGESTS = (
    "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, "
    "formatted_chars BIGINT"
)


def _digester(tokenizer: str):
    names = [f.split()[0] for f in DIGESTS.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        base = code.tokenizer.get_vocab_size()
        current, done = None, []

        def close():
            if current:
                conv, n, turns, chars, loss, formatted = current
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
            done.clear()
            return rows.cast(pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))

        for batch in batches:
            # Rows stay few at a time: a turn's ids may be long.
            for at in range(0, len(batch), 64):
                for row in batch.slice(at, 64).to_pylist():
                    if current is None or row["conv_id"] != current[0]:
                        close()
                        current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    ids = np.array(row["ids"], np.int64)
                    loss = (row["loss_from"] - row["start"], row["loss_to"] - row["start"])
                    role, text, masked = _parse(ids, loss, code.tokenizer, base)
                    current[1] += 1
                    current[2].update(f"{role}\n{text}\n".encode())
                    current[3] += len(masked)
                    current[4].update(masked.encode())
                    current[5] += row["n_chars"]
                if len(done) >= 1024:
                    yield flush()
        close()
        if done:
            yield flush()

    return digest


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, digests of what its ids and masks say. Turns stream past in order, so a
    conversation of any length needs no memory beyond a turn."""
    n = tasks(formatted.sparkSession)
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "start")
    return ordered.mapInArrow(_digester(tokenizer), DIGESTS)


def written(formatted: DataFrame) -> DataFrame:
    """``formatted`` as a Parquet table in the shared folder, read again."""
    return cut(formatted)
