"""Training-row preparation (P6, P7, L1-L3): chat rows, response masking, truncation and padding.

Tokenising is the tokenizer library's job; these operators take a token-array
column.  The fixtures use code points as tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone import constants as K

# FIXED VALUES: chat markers of the template
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
RESPONSE_MARKER = TURN_START + "assistant\n"


def chat_messages(prompt: Column, answer: Column | None = None, system: str = K.SYSTEM_PROMPT) -> Column:
    """[system, user(, assistant)] as array<struct<role, content>>; assistant only when not null."""
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    if answer is None:
        return msgs
    return F.when(answer.isNull(), msgs).otherwise(
        F.concat(msgs, F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))))


def sft_text(messages: Column) -> Column:
    """One chat string: ``<|im_start|>{role}\\n{content}<|im_end|>\\n`` per message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(TURN_END + "\n"))), "")


def conversation_pairs(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, answer): each user turn with turn + 1 of the same
    conversation when that is the assistant's.  An equi-join on the unique
    (conv_id, turn) key, so even a conversation holding a third of all turns is
    spread over many tasks (a window per conversation would put it in one)."""
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return users.join(answers, ["conv_id", "turn"], "inner")


def code_points(text: Column) -> Column:
    """Stand-in tokeniser: the code point of every character."""
    return F.transform(F.split(text, ""), lambda ch: F.ascii(ch))


def find_marker(ids: Column, marker: list[int]) -> Column:
    """L1: first start of ``marker`` inside ``ids``, -1 if absent (O(n) first-token test, then a slice compare)."""
    m = len(marker)
    lit = F.array(*[F.lit(x) for x in marker])
    hits = F.filter(F.sequence(F.lit(0), F.size(ids) - m),
                    lambda i: (F.element_at(ids, i + 1) == marker[0]) & (F.slice(ids, i + 1, m) == lit))
    return F.when(F.size(ids) < m, F.lit(-1)).otherwise(F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(-1)))


def response_mask(df: DataFrame, ids_col: str, marker: list[int], max_length: int, batch_col: str,
                  pad_id: int = 0, ignore: int = K.IGNORE_INDEX, fail_on_missing: bool = False) -> DataFrame:
    """L2 + L3: truncate to ``max_length``, pad right to the longest row of the batch,
    attention mask, labels = tokens with ``ignore`` up to and including the first marker
    and on padding.  Rows without the marker get ``marker_start = -1`` (or fail the job).
    """
    ids = F.slice(F.col(ids_col), 1, max_length)
    out = df.withColumn("__ids", ids).withColumn("seq_len", F.size("__ids"))
    out = out.withColumn("padded_len", F.max("seq_len").over(Window.partitionBy(batch_col)))
    out = out.withColumn("marker_start", find_marker(F.col("__ids"), marker))
    if fail_on_missing:
        out = out.withColumn("marker_start", F.when(F.col("marker_start") >= 0, F.col("marker_start")).otherwise(
            F.raise_error(F.lit("Assistant response marker not found"))))
    pad = F.array_repeat(F.lit(pad_id), F.col("padded_len") - F.col("seq_len"))
    ignore_pad = F.array_repeat(F.lit(ignore), F.col("padded_len") - F.col("seq_len"))
    cut = F.col("marker_start") + len(marker)
    labels = F.transform(F.col("__ids"), lambda t, i: F.when((F.col("marker_start") < 0) | (i < cut), F.lit(ignore)).otherwise(t))
    return (out.withColumn("input_ids", F.concat("__ids", pad))
               .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("seq_len")),
                                                      F.array_repeat(F.lit(0), F.col("padded_len") - F.col("seq_len"))))
               .withColumn("labels", F.concat(labels, ignore_pad))
               .drop("__ids"))
