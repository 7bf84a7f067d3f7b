"""Chat records of several layouts as canonical turns, and turns as one marked text.

A record is a JSON text. Its nested field paths (``messages``,
``messages[].role``, ...), as far as any mapping knows them, are sorted and
hashed; the hash selects a declarative mapping to turns ``(role, text)``.
Everything is built-in SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template, and one that breaks each up.
OPEN, SPLIT, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_BROKEN = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"

# Role names that other layouts use.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """A list of messages under ``items`` (with its role and text fields), or ``fields`` of the record by role."""

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: bool = True

    @property
    def paths(self) -> list[str]:
        listed = [self.items, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"] if self.items else []
        return sorted(listed + [f for _, names in self.fields for f in names])

    def turns(self, record: Column, lists: dict[str, Column]) -> Column:
        renamed = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        role = lambda c: F.coalesce(renamed[c], c, F.lit("")) if self.rename else F.coalesce(c, F.lit(""))
        text = lambda c: F.coalesce(c, F.lit(""))
        joined = [F.struct(F.lit(who).alias("role"), F.array_join(F.filter(F.array(*[text(record[f]) for f in names]), lambda x: x != ""), "\n").alias("text")) for who, names in self.fields]
        own = F.array(*joined) if joined else None
        if not self.items:
            return own
        made = F.transform(lists[self.items], lambda m: F.struct(role(m[self.role]).alias("role"), text(m[self.text]).alias("text")))
        return made if own is None else F.concat(own, made)


SYSTEM = ("system", ("system",))
MAPPINGS = [
    Mapping("rows", "rows", "role", "text", rename=False),
    Mapping("messages", "messages", "role", "content"),
    Mapping("messages with system", "messages", "role", "content", (SYSTEM,)),
    Mapping("conversations", "conversations", "from", "value"),
    Mapping("conversations with system", "conversations", "from", "value", (SYSTEM,)),
    Mapping("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system, prompt and response", fields=(SYSTEM, ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
]


def _nested(name: str, items: Column) -> Column:
    """Paths of the fields of a list's items; none if it is no list."""
    fields = F.array_distinct(F.flatten(F.transform(items, F.map_keys)))
    return F.coalesce(F.transform(fields, lambda k: F.concat(F.lit(f"{name}[]."), k)), F.array().cast("array<string>"))


def canonical_turns(records: DataFrame, column: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """Adds ``layout`` (the mapping's name) and ``turns`` array<struct<role,text>> to records with a JSON column.

    Fields no mapping names are ignored. A record whose fingerprint selects no
    mapping (a null or unreadable one too) stays, with null layout and turns.
    Null texts and roles become empty. Columns named layout or turns are replaced.
    """
    mappings = mappings or MAPPINGS
    known = sorted({p for m in mappings for p in m.paths})
    names = sorted({m.items for m in mappings if m.items})
    record = F.from_json(column, "map<string,string>")
    lists = {n: F.from_json(record[n], "array<map<string,string>>") for n in names}
    nested = [_nested(n, lists[n]) for n in names]
    paths = F.array_intersect(F.concat(F.map_keys(record), *nested), F.array(*[F.lit(p) for p in known]))
    # A generator, so that the record is read once and not once per use.
    read = F.inline(F.array(F.struct(record.alias("_record"), F.xxhash64(F.array_join(F.array_sort(paths), "\n")).alias("_print"), *[lists[n].alias(f"_list_{n}") for n in names])))
    found = records.select("*", read)
    chosen = lambda value: reduce(lambda rest, m: rest.when(F.col("_print") == F.xxhash64(F.lit("\n".join(m.paths))), value(m)), mappings[1:], F.when(F.col("_print") == F.xxhash64(F.lit("\n".join(mappings[0].paths))), value(mappings[0])))
    made = {n: F.col(f"_list_{n}") for n in names}
    out = found.withColumns({"layout": chosen(lambda m: F.lit(m.name)), "turns": chosen(lambda m: m.turns(F.col("_record"), made))})
    return out.drop("_record", "_print", *[f"_list_{n}" for n in names])


def escape(text: Column) -> Column:
    """Breaks up control strings by a backslash more after their first sign."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _BROKEN, "$1$2$3")


def format_turns(turns: Column) -> Column:
    """One text; each turn is ``<s>[INST]role[/INST]text</s>``, control strings inside escaped."""
    one = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SPLIT), escape(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def loss_runs(turns: Column) -> Column:
    """The loss mask as runs of code points of the formatted text: (chars, loss)."""
    frame = len(OPEN) + len(SPLIT)
    one = lambda t: F.array(
        F.struct((F.char_length(escape(t["role"])) + frame).alias("chars"), F.lit(False).alias("loss")),
        F.struct(F.char_length(escape(t["text"])).alias("chars"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(len(CLOSE)).alias("chars"), F.lit(False).alias("loss")),
    )
    return F.flatten(F.transform(turns, one))


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = lambda p: F.substring_index(p, SPLIT, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(head(p), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(p, F.char_length(head(p)) + len(SPLIT) + 1)).alias("text"),
        ),
    )


def rows_to_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, record): a JSON record per conversation, rows by turn.

    Rows with equal turns follow by role and text, null turns come first. A
    conversation is one text in the end, so its rows meet in one task.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return kept.select("conv_id", F.to_json(F.struct(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))).alias("record"))


def format_conversations(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds ``formatted`` and ``loss`` (runs of the mask) to records; null where no mapping fits."""
    found = canonical_turns(records, column)
    return found.withColumns({"formatted": format_turns(F.col("turns")), "loss": loss_runs(F.col("turns"))})


def under_mask(formatted: Column, runs: Column) -> Column:
    """The text of a formatted text that runs (chars, loss) mark, unescaped run by run, taken by their lengths."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("found"))
    piece = lambda s, r: unescape(F.substr(formatted, s["at"], r["chars"]))
    one = lambda s, r: F.struct(
        (s["at"] + r["chars"]).alias("at"), F.when(r["loss"], F.concat(s["found"], F.array(piece(s, r)))).otherwise(s["found"]).alias("found")
    )
    return F.array_join(F.aggregate(runs, start, one, lambda s: s["found"]), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its loss mask: turns, and the text under the mask.

    Where the mask has three runs per turn (header, text, close) of just the
    lengths that the turns have in the formatted text, the texts of marked turns
    are what lies under it, in one pass. Any other mask is followed by its lengths.
    """
    # As a generator's output the pieces are not split again by each that reads them.
    raw = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    back = formatted.select("conv_id", "formatted", "loss", F.explode(F.array(F.struct(raw.alias("raw"), read_turns(F.col("formatted")).alias("turns")))).alias("back"))
    back = back.select("conv_id", "formatted", "loss", F.col("back.raw").alias("raw"), F.col("back.turns").alias("back"))
    head = lambda p: F.char_length(F.substring_index(p, SPLIT, 1)) + len(SPLIT)
    sizes = F.flatten(F.transform("raw", lambda p: F.array(head(p), F.char_length(p) - head(p), F.lit(len(CLOSE)))))
    fits = sizes == F.transform("loss", lambda r: r["chars"])
    only_texts = ~F.exists(F.transform("loss", lambda r, i: r["loss"] & (i % 3 != 1)), lambda x: x)
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.filter("back", lambda t, i: F.get("loss", i * 3 + 1)["loss"])
    loss = F.when(fits & only_texts, F.array_join(F.transform(under, lambda t: t["text"]), "")).otherwise(under_mask(F.col("formatted"), F.col("loss")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        digest(whole).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
