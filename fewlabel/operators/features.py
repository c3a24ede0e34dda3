"""Text -> padded token arrays (``input_ids``, ``attention_mask``, ``token_type_ids``).

Tokens are lower-cased words (pattern is a parameter).  The vocabulary is a
table ``(token, token_id, n)``: special ids first, then tokens by count desc,
token asc; it holds every token unless a ``max_size`` is given.
Encoding is explode -> lookup join -> one regroup by id; tokens beyond
the truncation budget are dropped right after the explode, so at most
``max_length`` tokens per row are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.operators.ranks import range_rank

# Special tokens and their ids.
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIAL_IDS = {PAD: 0, UNK: 1, CLS: 2, SEP: 3}
WORD_PATTERN = r"[^\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text, pattern: str = WORD_PATTERN) -> Column:
    """Lower-case, split on ``pattern``, drop empty tokens (whole text)."""
    return F.array_remove(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), pattern), "")


def vocabulary(df: DataFrame, text_cols, pattern: str = WORD_PATTERN, max_size: int | None = None) -> DataFrame:
    """``(token, token_id, n)``: all tokens by count desc, token asc, with ids after the special
    ids; only the ``max_size`` most frequent ones if that is given.

    Counting is a partial aggregate; the counts are dealt by ranges, written once and numbered
    by their places there, so no task sees the whole vocabulary."""
    if isinstance(text_cols, str):
        text_cols = [text_cols]
    toks = None
    for c in text_cols:
        t = df.select(F.explode(tokenize(c, pattern)).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = range_rank(counts.withColumn("_neg", -F.col("n")), ["_neg", "token"], name="_rank")
    if max_size is not None:
        ranked = ranked.where(F.col("_rank") <= F.lit(int(max_size)))
    return ranked.select("token", (F.col("_rank") + len(SPECIAL_IDS) - 1).cast("bigint").alias("token_id"), "n")


def pair_budget(a_len: Column, b_len: Column, max_length: int) -> tuple[Column, Column]:
    """Kept lengths of a text pair under ``max_length - 3`` (one token at a
    time from the longer side, from the second text on ties)."""
    L = F.lit(max_length - 3)
    keep_a = F.least(a_len, F.greatest(F.ceil(L / 2).cast("int"), L - b_len))
    keep_b = F.least(b_len, F.greatest(F.floor(L / 2).cast("int"), L - a_len))
    return keep_a, keep_b


def encode_features(df: DataFrame, vocab: DataFrame, max_length: int, text_a: str = "sentence",
                    text_b: str | None = "topic", id_col: str = "id", label_col: str | None = "label",
                    pad_on_left: bool = False, pad_token: int = 0, pad_token_segment_id: int = 0,
                    mask_padding_with_zero: bool = True, pattern: str = WORD_PATTERN,
                    carry: Sequence[str] = ()) -> DataFrame:
    """``[CLS] a [SEP] b [SEP]`` ids, mask and segment ids padded to ``max_length``.

    ``id_col`` must be unique; the columns of ``carry`` come along.  Tokens missing from ``vocab`` map to ``[UNK]``.
    The output has ``id, input_ids, attention_mask, token_type_ids`` and the
    label column when given.  A length check raises on any other length.
    """
    ta = tokenize(text_a, pattern)
    tb = tokenize(text_b, pattern) if text_b else F.array().cast("array<string>")
    carry = [*([label_col] if label_col else []), *carry]
    base = df.select(F.col(id_col).alias("_id"), *carry, ta.alias("_ta"), tb.alias("_tb"))
    ka, kb = pair_budget(F.size("_ta"), F.size("_tb"), max_length)
    base = base.withColumns({"_ka": ka, "_kb": kb})
    tagged = F.concat(
        F.transform(F.slice("_ta", 1, F.col("_ka")),
                    lambda t, i: F.struct(F.lit(0).alias("side"), i.alias("pos"), t.alias("token"))),
        F.transform(F.slice("_tb", 1, F.col("_kb")),
                    lambda t, i: F.struct(F.lit(1).alias("side"), i.alias("pos"), t.alias("token"))))
    ex = base.select("_id", *carry, F.explode_outer(tagged).alias("t")).select(
        "_id", *carry, "t.side", "t.pos", "t.token")
    v = vocab.select(F.col("token"), F.col("token_id"))  # grows with the corpus: no broadcast hint
    j = ex.join(v, "token", "left").withColumn(
        "token_id", F.when(F.col("token").isNull(), F.lit(None)).otherwise(
            F.coalesce(F.col("token_id"), F.lit(SPECIAL_IDS[UNK]).cast("bigint"))))
    aggs = [F.sort_array(F.collect_list(F.when(F.col("token_id").isNotNull(),
                                               F.struct("side", "pos", "token_id")))).alias("_toks")]
    aggs += [F.first(c).alias(c) for c in carry]
    g = j.groupBy("_id").agg(*aggs)
    a_ids = F.transform(F.filter("_toks", lambda s: s["side"] == 0), lambda s: s["token_id"].cast("int"))
    b_ids = F.transform(F.filter("_toks", lambda s: s["side"] == 1), lambda s: s["token_id"].cast("int"))
    cls_, sep = F.array(F.lit(SPECIAL_IDS[CLS])), F.array(F.lit(SPECIAL_IDS[SEP]))
    ids = F.concat(cls_, a_ids, sep, b_ids, sep)
    g = g.select("_id", *carry, ids.alias("_ids"), F.size(a_ids).alias("_na"), F.size(b_ids).alias("_nb"))
    n = F.size("_ids")
    types = F.concat(F.array_repeat(F.lit(0), F.col("_na") + 2), F.array_repeat(F.lit(1), F.col("_nb") + 1))
    real, padv = (1, 0) if mask_padding_with_zero else (0, 1)
    mask = F.array_repeat(F.lit(real), n)
    pad_n = F.greatest(F.lit(max_length) - n, F.lit(0))
    pads = [F.array_repeat(F.lit(pad_token), pad_n), F.array_repeat(F.lit(padv), pad_n),
            F.array_repeat(F.lit(pad_token_segment_id), pad_n)]
    cols = [F.col("_ids"), mask, types]
    if pad_on_left:
        out = [F.concat(p, c) for p, c in zip(pads, cols)]
    else:
        out = [F.concat(c, p) for c, p in zip(cols, pads)]
    names = ["input_ids", "attention_mask", "token_type_ids"]
    res = g.select(F.col("_id").alias(id_col), *carry, *[o.alias(nm) for o, nm in zip(out, names)])
    check = F.assert_true((F.size("input_ids") == max_length) & (F.size("attention_mask") == max_length)
                          & (F.size("token_type_ids") == max_length), "encoded length differs from max_length")
    return res.where(check.isNull())


def encode_augmented(augmentations: DataFrame, examples: DataFrame, vocab: DataFrame, max_length: int,
                     label_col: str = "label", **kw) -> DataFrame:
    """Features of every augmented row, keyed by ``(id, aug_name, n, params)``: its text, an empty
    topic, and the label of its example.  Rows of other ids drop out."""
    lab = examples.select("id", label_col)
    if kw.get("pattern", WORD_PATTERN) == WORD_PATTERN:  # no more than a row's tokens go to the join
        augmentations = augmentations.withColumn("sentence", F.array_join(F.slice(tokenize("sentence"), 1, max_length), " "))
    rows = augmentations.join(lab, "id").withColumn(
        "_key", F.concat_ws("\u0001", "id", "aug_name", F.col("n").cast("string"), "params"))
    enc = encode_features(rows, vocab, max_length, "sentence", None, "_key", label_col, carry=("id", "aug_name", "n", "params"), **kw)
    return enc.drop("_key")


def left_truncate(tokens, keep: int = 1024) -> Column:
    """The last ``keep`` elements of an array."""
    t = _c(tokens)
    return F.slice(t, F.greatest(F.size(t) - F.lit(keep - 1), F.lit(1)), keep)


def pad_batch(df: DataFrame, tokens_col: str, batch_col: str, pad_value=PAD,
              out: str = "padded", mask_out: str = "mask") -> DataFrame:
    """Right-pad every array to the longest in its batch, with a 1/0 mask.
    The window is per batch (bounded by the batch size)."""
    from pyspark.sql import Window
    w = Window.partitionBy(batch_col)
    longest = F.max(F.size(tokens_col)).over(w)
    extra = longest - F.size(tokens_col)
    return df.withColumns({
        out: F.concat(F.col(tokens_col), F.array_repeat(F.lit(pad_value), extra)),
        mask_out: F.concat(F.array_repeat(F.lit(1), F.size(tokens_col)), F.array_repeat(F.lit(0), extra)),
    })


def mask_position(tokens, mask_token: str = MASK, prefix_len: int = 0) -> Column:
    """0-based position of the first mask token, shifted by a fixed prefix;
    null when absent."""
    p = F.array_position(_c(tokens), mask_token)
    return F.when(p > 0, (p - 1 + F.lit(prefix_len)).cast("bigint"))


def one_hot(position, length) -> Column:
    """``[0, .., 1 at position, .., 0]`` of the given length (at least 1): runs of zeros beside the one, so the
    position and the length are computed once a row, not once an element."""
    at, n = _c(position).cast("int"), _c(length).cast("int")
    inside = (at >= 0) & (at < n)
    hit = F.concat(F.array_repeat(F.lit(0), F.greatest(at, F.lit(0))), F.array(F.lit(1)), F.array_repeat(F.lit(0), F.greatest(n - at - 1, F.lit(0))))
    return F.when(inside, hit).otherwise(F.array_repeat(F.when(at.isNotNull(), F.lit(0)), n))
