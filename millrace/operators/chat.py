"""Conversations: parsing of four shapes, SFT rows with masks, DPO pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ASSISTANT, END, chat
from millrace.operators import tokenizer

DEFAULT_SYSTEM = "You are an expert coding assistant. You write clean, efficient, well-documented code."
MESSAGE = "array<struct<role:string,content:string>>"
#: All fields that a record may have; every one can be null.
SFT_SCHEMA = f"messages {MESSAGE}, conversations array<struct<from:string,role:string,value:string,content:string>>, instruction string, response string, problem string, solution string, system string"


def conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, messages in order of the turn."""
    item = F.struct(order, "role", F.col("text").alias("content"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    return rows.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def parsed(records: DataFrame, default_system: str = DEFAULT_SYSTEM) -> DataFrame:
    """records with `system` and `chat_messages` by the first shape that is there; rows without messages go."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))

    def shared(m: Column) -> Column:
        who = F.coalesce(m["from"], m["role"], F.lit(""))
        return F.struct(F.when(who.isin("human", "user"), "user").when(who.isin("gpt", "assistant"), "assistant").alias("role"), F.coalesce(m["value"], m["content"], F.lit("")).alias("content"))

    pair = lambda a, b: F.array(say("user", F.col(a)), say("assistant", F.col(b))).cast(MESSAGE)
    found = (
        F.when(F.col("messages").isNotNull(), F.col("messages"))
        .when(F.col("conversations").isNotNull(), F.filter(F.transform("conversations", shared), lambda m: m["role"].isNotNull()).cast(MESSAGE))
        .when(F.col("instruction").isNotNull() & F.col("response").isNotNull(), pair("instruction", "response"))
        .when(F.col("problem").isNotNull() & F.col("solution").isNotNull(), pair("problem", "solution"))
    )
    system = F.coalesce(F.nullif("system", F.lit("")), F.lit(default_system))
    return records.withColumn("chat_messages", found).withColumn("system", system).where(F.size("chat_messages") > 0)


def assistant_spans(system: Column, messages: Column) -> Column:
    """start, length of each assistant turn's content in the rendered text, in characters."""
    kept = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    head = F.length(F.concat(F.lit("<|system|>\n"), system, F.lit(END)))
    start = F.struct(head.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        opened = acc["at"] + 1 + F.length(m["role"]) + len("<||>\n")
        size = F.length(m["content"])
        spans = F.when(m["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(opened.alias("start"), size.alias("length"))))).otherwise(acc["spans"])
        return F.struct((opened + size + len(END)).alias("at"), spans.alias("spans"))

    return F.aggregate(kept, start, step)["spans"]


def sft_rows(chats: DataFrame, key: str, system: Column, max_len: int) -> DataFrame:
    """key, n_input, n_loss, text: character tokens of the rendered chat, cut to max_len, four at least; targets are the
    next token inside of assistant turns and -1 elsewhere, so n_loss counts the positions that train."""
    text, spans = chat(system, F.col("messages")), assistant_spans(system, F.col("messages"))
    rows = chats.select(key, text.alias("text"), spans.alias("spans")).withColumn("kept", F.least(F.length("text"), F.lit(max_len))).where(F.col("kept") >= 4)
    # A span covers tokens start..start+length-1; target i is token i+1, so token 0 is never one.
    covered = F.aggregate(F.col("spans"), F.lit(0), lambda a, s: a + F.greatest(F.least(s["start"] + s["length"], F.col("kept")) - F.least(s["start"], F.col("kept")), F.lit(0)))
    return rows.select(key, (F.col("kept") - 1).alias("n_input"), covered.alias("n_loss"), F.substring(F.col("text"), F.lit(1), F.col("kept")).alias("text"))


def sft_tokens(chats: DataFrame, merges: list[tuple[bytes, bytes]], key: str, system: Column, max_len: int) -> DataFrame:
    """key, input_ids, targets: the rendered chat in the tokenizer's own tokens, cut to max_len, four at least; targets are
    the next token inside of assistant turns and -1 elsewhere.

    Which tokens are an assistant's follows from the numbers of tokens before its content and up to its end. A null
    content counts as the empty one; chats without turns have their system part alone; repeated rows have a row each.
    """
    said = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    rows = chats.select(key, chat(system, said).alias("__text"), assistant_spans(system, said).alias("__spans"))
    made = tokenizer.encode_spans(rows, merges, "__text", "__spans", keep=(key,))
    cut = made.select(key, F.slice("ids", 1, max_len).alias("ids"), F.slice("mask", 1, max_len).alias("mask")).where(F.size("ids") >= 4)
    return cut.select(key, F.slice("ids", F.lit(1), F.size("ids") - 1).alias("input_ids"), targets(F.col("ids"), F.col("mask")).alias("targets"))


def targets(ids: Column, mask: Column) -> Column:
    """The next id where the mask of that id holds, else -1."""
    return F.zip_with(F.slice(ids, F.lit(2), F.size(ids) - 1), F.slice(mask, F.lit(2), F.size(mask) - 1), lambda i, m: F.when(m, i).otherwise(-1))


def char_ids(text: Column) -> Column:
    """Code points as ids."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def dpo_pair(prompt: Column, response: Column, max_len: int, bos: int = 1, eos: int = 2) -> Column:
    """input_ids and labels of character tokens in bos and eos, cut; labels of the prompt are -1."""
    wrap = lambda ids: F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))
    ids = F.slice(wrap(char_ids(F.concat(prompt, response))), 1, max_len)
    start = F.greatest(F.length(prompt) + 1, F.lit(0))
    following = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    labels = F.transform(following, lambda t, i: F.when(i < start, -1).otherwise(t))
    return F.struct(F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))).alias("input_ids"), labels.alias("labels"))


def complete_pairs(records: DataFrame) -> DataFrame:
    """DPO records whose three fields are neither null nor empty."""
    return records.where(" AND ".join(f"coalesce({c}, '') <> ''" for c in ("prompt", "chosen", "rejected")))


def dpo_metrics(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row from log-probabilities pi_chosen, pi_rejected, ref_chosen, ref_rejected."""
    won, lost = (F.col("pi_chosen") - F.col("ref_chosen")) * beta, (F.col("pi_rejected") - F.col("ref_rejected")) * beta
    return df.agg(
        F.avg(F.log1p(F.exp(-(won - lost)))).alias("loss"), F.avg(F.when(won > lost, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(won).alias("reward_chosen"), F.avg(lost).alias("reward_rejected"), F.avg(won - lost).alias("reward_margin"),
    )
