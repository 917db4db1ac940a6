"""String functions of the corpus pipeline as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import bind

# File suffix to language. Suffixes match case and all.
EXTENSION_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go",
    ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".lua": "lua", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".sql": "sql", ".r": "r", ".R": "r",
    ".m": "matlab", ".jl": "julia", ".html": "html", ".css": "css", ".scss": "css", ".xml": "xml",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".rst": "markdown",
}

# The characters that count as white space, as a pattern's class with and without the newline, as text, and
# as the class in the SQL's dialect.
_BEYOND = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), *_BEYOND)))
BLANK = r"[\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = BLANK.replace(r"\t\x0b-", r"\t-")
BLANK_SQL, SPACES_SQL = (re.sub(r"\\(?:x([89a-f][0-9a-f])|u(\w{4}))", lambda m: rf"\x{{{m[1] or m[2]}}}", c) for c in (BLANK, SPACES))

# Headers at the top of a file, tried in this order.
LICENSE_HEADERS = (
    r"(?s)\A/\*.*?\*/\s*\n",
    r"(?i)\A#[^\n]*license[^\n]*\n(?:#[^\n]*\n)*",
    r"(?i)\A//[^\n]*license[^\n]*\n(?://[^\n]*\n)*",
)

# Sentinels.
FIM_PREFIX, FIM_MIDDLE, FIM_SUFFIX = "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>"
REPO_NAME, FILE_SEP = "<|repo_name|>", "<|file_sep|>"
SYSTEM, USER, ASSISTANT, END = "<|system|>", "<|user|>", "<|assistant|>", "<|end|>"
IM_START, IM_END = "<|im_start|>", "<|im_end|>"


def language_of_path(path: Column) -> Column:
    """Language by the path's last suffix; null if it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair])
    return table[F.nullif(F.regexp_extract(path, r"(\.[A-Za-z]+)\z", 1), F.lit(""))]


def strip(text: Column) -> Column:
    """Without the white space at both ends; looked for from the ends, not in the whole text."""
    return F.trim(text, F.lit(SPACE))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def normalize_whitespace(code: Column, tab: int = 4) -> Column:
    """Tabs to spaces, no white space at line ends, two blank lines in a row at most, one newline at the end."""
    out = F.replace(code, F.lit("\t"), F.lit(" " * tab))
    out = F.regexp_replace(out, BLANK + r"+(\n|\z)", "$1")
    out = F.regexp_replace(out, r"\n{4,}", "\n\n\n")
    return F.concat(strip(out), F.lit("\n"))


def strip_license_header(code: Column) -> Column:
    """Headers that speak of a license go, each pattern on what the one before it left; then leading newlines."""

    def without(pattern: str) -> Callable[[Column], Column]:
        def cut(text: Column) -> Column:
            return bind(F.regexp_extract(text, pattern, 0), lambda head: F.when(F.lower(head).contains("license"), F.substring(text, F.length(head) + 1, F.length(text))).otherwise(text))

        return cut

    # Only texts that begin with a mark of a comment can have a header, at the first step or behind another one.
    first, second, third = map(without, LICENSE_HEADERS)
    whole = bind(bind(first(code), second), third)
    return F.regexp_replace(F.when(code.rlike(r"\A(?:/\*|#|//)"), whole).otherwise(code), r"\A\n+", "")


def preprocessed(code: Column, max_line: int = 1000, min_lines: int = 3, max_lines: int = 10_000) -> Column:
    """Header off, white space normal; null for blank text, too few or many lines, or a line that is too long.

    The newline at the end counts as one more, empty line.
    """

    def fitting(out: Column) -> Column:
        n = F.length(out) - F.length(F.replace(out, F.lit("\n"), F.lit(""))) + 1
        return F.when(n.between(min_lines, max_lines) & ~out.rlike(rf"(?md)^[^\n]{{{max_line + 1}}}"), out)

    whole = lambda text: F.when(strip(text) != "", bind(bind(strip_license_header(text), lambda t: normalize_whitespace(t)), fitting))
    return bind(code, whole)


def decontamination_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACES + "+", " "))


def words(text: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(text, SPACES + "+", -1), lambda w: w != "")


def word_ngrams(tokens: Column, n: int) -> Column:
    """Runs of n words joined by a space; with fewer words the one run of all; none without words or for null."""

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(made)

    return bind(F.coalesce(tokens, F.array().cast("array<string>")), runs)


def repo_context(name: Column, files: Column) -> Column:
    """Repository header, then path and content of each file of an array of structs."""
    body = F.flatten(F.transform(files, lambda f: F.array(F.concat(F.lit(FILE_SEP), f["path"]), f["content"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit(REPO_NAME), name)), body), "\n")


def chat(system: Column, messages: Column, generation_prompt: bool = False) -> Column:
    """System prompt and the turns of user and assistant; other roles go, a null content is an empty one."""
    kept = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    turns = F.transform(kept, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit(END)))
    parts = F.concat(F.array(F.concat(F.lit(SYSTEM + "\n"), system, F.lit(END))), turns)
    if generation_prompt:
        parts = F.concat(parts, F.array(F.lit(ASSISTANT + "\n")))
    return F.array_join(parts, "\n")


def chatml(messages: Column, generation_prompt: bool = False) -> Column:
    """The turns of every role; a null content is an empty one."""
    turns = F.transform(messages, lambda m: F.concat(F.lit(IM_START), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(IM_END + "\n")))
    return F.concat(F.array_join(turns, ""), F.lit(IM_START + "assistant\n" if generation_prompt else ""))


# Names of tensors outside of layers, and the parts of a layer.
TENSOR_NAMES = {"tok_embeddings.weight": "token_embd.weight", "norm.weight": "output_norm.weight", "output.weight": "output.weight"}
LAYER_PARTS = {
    "attn_norm.weight": "attn_norm.weight", "attn.wq.weight": "attn_q.weight", "attn.wk.weight": "attn_k.weight",
    "attn.wv.weight": "attn_v.weight", "attn.wo.weight": "attn_output.weight", "attn.q_norm.weight": "attn_q_norm.weight",
    "attn.k_norm.weight": "attn_k_norm.weight", "ffn_norm.weight": "ffn_norm.weight", "ffn.gate_proj.weight": "ffn_gate.weight",
    "ffn.up_proj.weight": "ffn_up.weight", "ffn.down_proj.weight": "ffn_down.weight",
}


def exported_name(name: Column) -> Column:
    """layers.N.part becomes blk.N.part with the part's export name, if it has one; other names by their table, else as they are."""
    table = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    layer, part = F.regexp_extract(name, r"\Alayers\.(\d+)\.(.+)\z", 1), F.regexp_extract(name, r"\Alayers\.(\d+)\.(.+)\z", 2)
    inside = F.concat(F.lit("blk."), layer, F.lit("."), F.coalesce(table(LAYER_PARTS)[part], part))
    return F.when(layer != "", inside).otherwise(F.coalesce(table(TENSOR_NAMES)[name], name))


def coding_task(code: Column, explanation: Column, language: Column) -> Column:
    block = F.concat(F.lit("```"), language, F.lit("\n"), code, F.lit("\n```"))
    return F.concat(block, F.when(F.coalesce(explanation, F.lit("")) != "", F.concat(F.lit("\n\n"), explanation)).otherwise(""))


def trim_to_first_definition(completion: Column) -> Column:
    """Up to the next line that begins a definition or class, if a line before it was kept."""

    def cut(parts: Column) -> Column:
        stop = F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.coalesce(F.get(parts, i - 1), F.lit("")).rlike(r"\A\s*(def |class )")))
        return F.array_join(F.when(stop.isNull(), parts).otherwise(F.slice(parts, F.lit(1), stop - 1)), "\n")

    return bind(lines(completion), cut)


def trim_to_second_def(completion: Column) -> Column:
    """Up to the second line that begins with `def `."""

    def cut(parts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.get(parts, i - 1).startswith("def "))
        return F.array_join(F.when(F.size(starts) < 2, parts).otherwise(F.slice(parts, F.lit(1), F.get(starts, F.lit(1)) - 1)), "\n")

    return bind(lines(completion), cut)


def chat_reply(full: Column, prompt: Column) -> Column:
    return strip(F.substring_index(F.substring(full, F.length(prompt) + 1, F.length(full)), END, 1))


def fim_parts(text: Column) -> Column:
    """prefix and suffix around `|||`; null unless there are exactly two parts."""
    parts = F.split(text, r"\|\|\|", -1)
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("suffix")))
