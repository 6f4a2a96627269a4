"""Chat formatting (operator 8): transcripts become canonical turns.

A transcript is a sequence of blocks (turns) of lines.  A row that names a
speaker after its first line holds several and is cut into its blocks; any
other row is one block.  A hidden Markov model,
whose hidden state is the role of a block, emits the features of its lines:
speaker marker, place in the block, length, question mark, list or code line.
Start, transition and emission probabilities are counts over all labelled
turns, smoothed by one.  Viterbi recovers the roles, and each turn is rendered
as ``<|role|>\\n text <|end|>``.

A conversation may hold any share of all rows, so Viterbi runs on chunks of
``CHUNK`` turns: each task reduces its chunk to a max-plus matrix (best score
from the role before the chunk to the role at its end); matrices of chunks are
reduced in the same way until few are left per conversation, solved there,
and each level's end roles fix the next level's.

Edge cases: null text is the empty text (one empty line); rows with a null
conversation or turn have no place in a transcript and are rendered as a
conversation of their own; repeated rows are one turn; turns with equal numbers
stand in the order of their text; roles outside the model's are not learned
from, nor is the one role of a row with several blocks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import stored

ROLES = ("system", "user", "assistant")
START = len(ROLES)                  # the state before the first turn
CHUNK = 256
#: Speaker markers at the start of a line, by the role they usually name.
MARKERS = ("(?i)^\\s*(system|instructions?)\\s*[:>]", "(?i)^\\s*(user|human|question|q|me)\\s*[:>]",
           "(?i)^\\s*(assistant|bot|ai|answer|a)\\s*[:>]", "^\\s*([-*>#]|\\d+[.)]|```)")
SYMBOLS = 5 * 2 * 2 * 8


#: A speaker after the first line of a text, and where such a text is cut.
SPEAKER = "\\n[ \\t]*(?i:system|user|human|assistant|bot|ai|question|answer)[ \\t]*:"
CUT = f"\\n[ \\t]*\\n|\\n(?={SPEAKER[2:]})"


def split_transcripts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, text) of raw transcripts: a block starts after a blank
    line or at a speaker marker."""
    return df.select(F.col(id_col).alias("conv_id"), F.posexplode(F.split(
        F.coalesce(text_col, F.lit("")), CUT)).alias("turn", "text")).withColumn("turn", F.col("turn").cast("long"))


def line_symbols(text):
    """One small number per line: its features together."""
    def symbol(line, i):
        marker = F.lit(0)
        for k, pattern in enumerate(MARKERS):
            marker = F.when((marker == 0) & line.rlike(pattern), k + 1).otherwise(marker)
        size = F.least(F.log2(F.length(line) + 1.0).cast("int"), F.lit(7))
        place = F.when(i == 0, 0).otherwise(1)
        asks = F.when(F.rtrim(line).endswith("?"), 1).otherwise(0)
        return ((marker * 2 + place) * 2 + asks) * 8 + size
    return F.transform(F.split(text, "\n"), symbol)


def turns_of(rows: DataFrame) -> DataFrame:
    """Blocks of the distinct turns with their place, chunk and line symbols;
    ``whole`` is the text of a turn with several blocks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    cols = ["conv_id", "turn", "text", *(["role"] if "role" in rows.columns else [])]
    several = F.col("text").rlike(SPEAKER)
    role = [F.when(~several, F.col("role")).alias("role")] if cols[3:] else []
    return rows.select("conv_id", "turn", text.alias("text"), *cols[3:]).distinct().withColumn(
        "conv", F.when(alone, F.concat_ws(" ", F.lit("row"), F.xxhash64(*cols).cast("string"),
                                          F.sha2(F.col("text"), 256))).otherwise(
            F.concat(F.lit("="), F.col("conv_id").cast("string")))).withColumn(
        "chunk", F.when(alone, F.lit(0)).otherwise(F.floor(F.col("turn") / CHUNK)).cast("long")).select(
        "conv_id", "turn", *role, "conv", "chunk", F.when(several, F.col("text")).alias("whole"), F.posexplode(
            F.when(several, F.split("text", CUT)).otherwise(F.array("text"))).alias("block", "text")).withColumn(
        "symbols", line_symbols(F.col("text")))


def fit(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from counts over all labelled turns; start and
    transition counts meet by an equi-join on the turn, after turns with equal
    numbers are counted by role."""
    code = F.create_map(*[x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(i))])
    known = turns.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
                        ).withColumn("r", F.get(F.array(*[F.lit(i) for i in range(len(ROLES))]), code[F.col("role")]))
    emit, move = np.ones((START, SYMBOLS)), np.ones((START + 1, START))
    for r in known.select("r", F.explode("symbols").alias("s")).groupBy("r", "s").count().collect():
        emit[r["r"], r["s"]] += r["count"]
    after = known.groupBy("conv", "turn", "r").agg(F.count("r").cast("double").alias("n"))
    before = after.select("conv", (F.col("turn") + 1).alias("turn"), F.col("r").alias("p"), F.col("n").alias("m"))
    for r in after.join(before, ["conv", "turn"], "left").groupBy("p", "r").agg(
            F.sum(F.col("n") * F.coalesce("m", F.lit(1.0))).alias("moves")).collect():
        move[START if r["p"] is None else r["p"], r["r"]] += r["moves"]
    return {"emit": np.log(emit / emit.sum(1, keepdims=True)), "move": np.log(move / move.sum(1, keepdims=True))}


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: (before, middle) and (middle, end) to (before, end)."""
    return (a[:, :, None] + b[None, :START, :]).max(1)


def best_path(steps: list[np.ndarray], before: int, end: int) -> list[int]:
    """End state of each step on a best path; ``end`` below 0 is free."""
    scores, back = steps[0][before], []
    for m in steps[1:]:
        total = scores[:, None] + m[:START]
        back.append(total.argmax(0))
        scores = total.max(0)
    path = [int(scores.argmax()) if end < 0 else end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def turn_steps(model: dict, symbols) -> list[np.ndarray]:
    return [model["move"] + model["emit"][:, np.asarray(s, int)].sum(1)[None, :] for s in symbols]


def product(steps: list[np.ndarray]) -> list[float]:
    out = steps[0]
    for m in steps[1:]:
        out = compose(out, m)
    return out.ravel().tolist()


def matrices(flat) -> list[np.ndarray]:
    return [np.reshape(m, (START + 1, START)) for m in flat]


def recover_roles(turns: DataFrame, model: dict) -> DataFrame:
    """Adds ``state``, the index of each turn's most probable role.

    Turns are gathered once into one row per chunk; Python sees only the line
    symbols of many chunks in one Arrow batch, and the texts stay in the JVM."""
    shared = turns.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def reduce_turns(symbols: pd.Series) -> pd.Series:
        return pd.Series([product(turn_steps(shared.value, s)) for s in symbols])

    @F.pandas_udf("array<double>")
    def reduce_chunks(flat: pd.Series) -> pd.Series:
        return pd.Series([product(matrices(f)) for f in flat])

    @F.pandas_udf("array<int>")
    def place_chunks(flat: pd.Series, before: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([best_path(matrices(f), b, e) for f, b, e in zip(flat, before, end)])

    @F.pandas_udf("array<int>")
    def place_turns(symbols: pd.Series, before: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([best_path(turn_steps(shared.value, s), b, e) for s, b, e in zip(symbols, before, end)])

    order = F.coalesce("whole", "text").alias("order")   # blocks of one text stay together
    chunks = stored(turns.groupBy("conv", "chunk").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("turn", order, "block", "text", "symbols", "conv_id"))), lambda t: t.dropFields("order")).alias(
        "turns")), "chat-chunks")
    levels = [stored(chunks.select("conv", F.col("chunk").alias("idx"), reduce_turns("turns.symbols").alias("m")),
                     "chat-level")]

    def gathered(rows, *more):
        return rows.groupBy("conv", "up").agg(
            F.sort_array(F.collect_list(F.struct("idx", "m"))).alias("parts"), *more)

    most = "max(abs(idx)) as top"
    while (levels[-1].selectExpr(most).first()["top"] or 0) >= CHUNK:
        above = gathered(levels[-1].withColumn("up", F.floor(F.col("idx") / CHUNK)))
        levels.append(stored(above.select("conv", F.col("up").alias("idx"), reduce_chunks("parts.m").alias("m")),
                             "chat-level"))
    spots = None
    for level in reversed(levels):
        if spots is None:
            rows = level.withColumn("up", F.lit(0).cast("long")).withColumn("before", F.lit(START)).withColumn(
                "end", F.lit(-1))
        else:
            rows = level.withColumn("up", F.floor(F.col("idx") / CHUNK)).join(
                spots.withColumnRenamed("idx", "up"), ["conv", "up"])
        path = gathered(rows, F.first("before").alias("before"), F.first("end").alias("end")).select(
            "conv", "parts", "before", place_chunks("parts.m", "before", "end").alias("path"))
        spots = stored(path.select("conv", F.posexplode(F.arrays_zip(
            F.col("parts.idx").alias("idx"), F.concat(F.array("before"), F.expr("slice(path, 1, size(path) - 1)")).alias(
                "before"), F.col("path").alias("end"))).alias("i", "s")).select("conv", "s.idx", "s.before", "s.end"),
            "chat-spots")
    placed = chunks.join(spots.withColumnRenamed("idx", "chunk"), ["conv", "chunk"]).select(
        "conv", "turns", place_turns("turns.symbols", "before", "end").alias("states"))
    return placed.select("conv", F.explode(F.arrays_zip("turns", "states")).alias("t")).select(
        "conv", "t.turns.conv_id", "t.turns.turn", "t.turns.block", "t.turns.text", F.col("t.states").alias("state"))


def render(role, text):
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>"))


def format_chats(rows: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per block of a turn: ``conv_id, turn, block, role_found, rendered``.  The input has
    ``conv_id, turn, text``, and ``role`` where the model is to be fitted."""
    turns = stored(turns_of(rows), "chat-turns")
    model = model or fit(turns)
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("state"))
    return recover_roles(turns, model).select(
        "conv_id", "turn", "block", role.alias("role_found"), render(role, F.col("text")).alias("rendered"))
