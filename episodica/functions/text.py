"""Text expressions: coordinates, normal forms, line kinds, prompts.

Coordinates are written `<row, col>`. A missing text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how the data write a coordinate.
COORD = r"<\s*(-?\d+)\s*,\s*(-?\d+)\s*>"
#: Two blanks stand before the evidence mark.
EVIDENCE = "  [sam]"
#: Numbers of words, ordinals, and kinds of things that are lifted, in order.
QUANTITIES = {"a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
#: Texts that stand for no action.
IDLE = ("static", "remain static", "all tasks completed", "no record", "")
ORDINALS = ("first", "second", "third", "fourth", "fifth")
LIFTED = ("container", "peg", "stick", "cube")
ARTICLES = ("the", "a", "another")
#: The texts that decide how often a record is repeated, in order.
MOVED = ("moved to", "moved from", "being moved", "is now under", "is under the container")
PUT = ("completed: put down", "completed: put it down", "completed: pick up the container")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def coords(c: Column) -> Column:
    """All coordinates as array<struct<r, c>>, in order."""
    r, k = (F.regexp_extract_all(text(c), F.lit(COORD), F.lit(i)) for i in (1, 2))
    return F.zip_with(r, k, lambda a, b: F.struct(a.cast("int").alias("r"), b.cast("int").alias("c")))


def detections(c: Column) -> Column:
    """Tokens such as `red_cube<10, 20>` as array<struct<name, r, c>>."""
    token = r"(\w+)" + COORD
    n, r, k = (F.regexp_extract_all(text(c), F.lit(token), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(n.alias("n"), r.alias("r"), k.alias("k")), lambda z: F.struct(z["n"].alias("name"), z["r"].cast("int").alias("r"), z["k"].cast("int").alias("c")))


def shown(dets: Column) -> Column:
    """Detections as text; `(none)` when there are none."""
    parts = F.transform(dets, lambda d: F.format_string("%s<%d, %d>", d["name"], d["r"], d["c"]))
    return F.when(F.size(F.coalesce(dets, F.array())) > 0, F.array_join(parts, ", ")).otherwise(F.lit("(none)"))


def without_at(c: Column) -> Column:
    """`at <r, c>` deleted: one of the two coordinate-free forms."""
    return F.trim(F.regexp_replace(text(c), r"\s*at\s*" + COORD, ""))


def blank_coords(c: Column) -> Column:
    """Coordinates replaced by `<>`, event mark and evidence dropped, blanks joined, lowered: the other form."""
    s = F.replace(F.regexp_replace(text(c), COORD, "<>"), F.lit("[event]"), F.lit(""))
    return F.lower(F.trim(F.regexp_replace(F.substring_index(s, EVIDENCE, 1), r"\s+", " ")))


def without_evidence(c: Column) -> Column:
    return F.substring_index(text(c), EVIDENCE, 1)


def plain(c: Column) -> Column:
    """Lowered, trimmed, without a final period."""
    return F.regexp_replace(F.trim(F.lower(text(c))), r"\.$", "")


def object_name(c: Column) -> Column:
    """The words after the first article, up to ` at <`, joined by underscores; `object` where there are none.

    A word with other signs than letters, digits, `_` and `-` ends a name; a later article begins another.
    """
    words = F.filter(F.split(F.substring_index(text(c), "at <", 1), r"\s+"), lambda w: w != "")
    none = F.struct(F.lit(False).alias("named"), F.array().cast("array<string>").alias("kept"))

    def step(s, w):
        grown = F.struct(F.lit(True).alias("named"), F.array_append(s["kept"], w).alias("kept"))
        begun = F.struct(w.isin(*ARTICLES).alias("named"), none["kept"].alias("kept"))
        return F.when(w.rlike(r"[^\w\-]"), none).when(s["named"], grown).otherwise(begun)

    kept = F.aggregate(words, none, step)["kept"]
    return F.when(F.size(kept) > 0, F.array_join(kept, "_")).otherwise(F.lit("object"))


def humanise(c: Column, names: dict[str, str] | None = None) -> Column:
    """The name that is given for the text, else the text with blanks for underscores."""
    plain_ = F.replace(text(c), F.lit("_"), F.lit(" "))
    for k, v in (names or {}).items():
        plain_ = F.when(text(c) == k, v).otherwise(plain_)
    return plain_


def lines(c: Column) -> Column:
    """Trimmed lines without empty ones and `NONE`."""
    parts = F.transform(F.split(text(c), "\n", -1), F.trim)
    return F.filter(parts, lambda x: (x != "") & (F.upper(x) != "NONE"))


def line_kind(c: Column) -> Column:
    """The kind of an event line; the first rule that fits decides."""
    s = F.lower(text(c))
    rules = (
        ("SCENE", s.contains("scene:")),
        ("HIGHLIGHT", s.contains("highlight appeared")),
        ("APPEAR", s.contains("appeared at")),
        ("COVER", s.contains("placed over")),
        ("MOVE", s.contains("moved to") | s.contains("moved from") | s.contains("being moved")),
        ("REACH", s.contains("reached the target")),
        ("DONE", s.contains("completed:")),
    )
    out = F.lit("OTHER")
    for kind, rule in reversed(rules):
        out = F.when(rule, kind).otherwise(out)
    return out


def instruction_kind(c: Column) -> Column:
    """What the first word asks for; `put` asks to place."""
    verb = F.regexp_extract(F.lower(text(c)), "^(pick|place|put|pour|open|close)", 1)
    return F.when(verb == "put", "place").when(verb == "", "other").otherwise(verb)


def first_keyword(c: Column, words: list[str], otherwise: str | None = None) -> Column:
    """The first of words, in their order, that the text contains."""
    s, out = F.lower(text(c)), F.lit(otherwise)
    for w in reversed(words):
        out = F.when(s.contains(w), w).otherwise(out)
    return out


def ordinal(c: Column) -> Column:
    """The number of the first ordinal word; null if there is none."""
    numbers = F.create_map(*[x for k, w in enumerate(ORDINALS) for x in (F.lit(w), F.lit(k + 1))])
    word = F.regexp_extract(F.lower(text(c)), r"\b(" + "|".join(ORDINALS) + r")\b", 1)
    return F.when(word != "", numbers[word])


def repeats(c: Column) -> Column:
    """How often a record with this target is written."""
    s = F.lower(text(c))
    any_of = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(s, x))
    many = F.contains(text(c), F.lit("\n"))
    return F.when(any_of(MOVED), 8).when(any_of(PUT), 4).when(many, 3).when(s.contains("reached the target"), 3).otherwise(1)


def prompt(instruction: Column, bank: Column, expected: Column) -> Column:
    shown_bank = F.when(F.size(bank) > 0, F.array_join(bank, "\n")).otherwise(F.lit("(empty)"))
    return F.concat(F.lit("Task: "), text(instruction), F.lit("\nMemory:\n"), shown_bank, F.lit("\nExpected next: "), F.coalesce(expected, F.lit("NONE")))


def chat(system: Column, user: Column, answer: Column) -> Column:
    """Messages as array<struct<role, content>>."""
    turns = (("system", system), ("user", user), ("assistant", answer))
    return F.array(*[F.struct(F.lit(r).alias("role"), text(c).alias("content")) for r, c in turns])


def number(c: Column, words: dict[str, int] | None = None) -> Column:
    """The number of a word; null if it is none of them."""
    known = F.create_map(*[F.lit(x) for pair in (words or QUANTITIES).items() for x in pair])
    return F.try_element_at(known, F.lower(text(c)))


def color_quota(c: Column, colors: tuple[str, ...] = ("red", "green", "blue"), thing: str = "cube") -> Column:
    """How many things of each color a text asks for, as array<struct<color, n>> in the order of colors."""
    pattern = F.lit(rf"(\w+) ({'|'.join(colors)}) {thing}")
    words, named = (F.regexp_extract_all(F.lower(text(c)), pattern, F.lit(i)) for i in (1, 2))
    asked = F.zip_with(words, named, lambda w, k: F.struct(F.coalesce(number(w), F.lit(0)).alias("n"), k.alias("color")))
    total = lambda k: F.aggregate(asked, F.lit(0), lambda a, x: a + F.when(x["color"] == k, x["n"]).otherwise(0))
    sums = F.array(*[F.struct(F.lit(k).alias("color"), total(k).alias("n")) for k in colors])
    return F.filter(sums, lambda x: x["n"] > 0)


def highlight(c: Column) -> Column:
    """struct<ordinal, r, c, color> of a highlighted cube; its parts are null where the text has none.

    The ordinal is the word before `highlighted cube at`, the color the one after `which is`.
    """
    mark = "\x01"
    s = F.regexp_replace(F.lower(text(c)), r"highlighted cube at\s+<", mark + "<")
    before, after = F.substring_index(s, mark, 1), F.split_part(s, F.lit(mark), F.lit(2))
    found, at = after != "", F.get(coords(after), F.lit(0))
    word = F.element_at(F.split(F.rtrim(before), r"\s+"), -1)
    rest = F.split_part(after, F.lit(">"), F.lit(2))
    told = F.split(F.ltrim(F.ltrim(rest, F.lit(","))), r"\W+")
    color = F.when(rest.startswith(",") & (F.get(told, F.lit(0)) == "which") & (F.get(told, F.lit(1)) == "is"), F.nullif(F.get(told, F.lit(2)), F.lit("")))
    parts = (F.when(word.isin(*ORDINALS), word).alias("ordinal"), at["r"].alias("r"), at["c"].alias("c"), color.alias("color"))
    return F.struct(*[F.when(found, p).alias(n) for p, n in zip(parts, ("ordinal", "r", "c", "color"))])


def lift_class(c: Column) -> Column:
    """What kind of thing a text says is lifted."""
    return first_keyword(c, list(LIFTED), LIFTED[-1])


def move_coords(c: Column, place) -> Column:
    """The text with each coordinate replaced by place(r, c), a struct with r and c."""
    between, at = F.split(text(c), COORD, -1), coords(c)
    moved = F.transform(at, lambda p: place(p["r"], p["c"]))
    written = F.transform(moved, lambda p: F.format_string("<%d, %d>", p["r"], p["c"]))
    return F.array_join(F.zip_with(between, written, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def readout(*values: Column) -> Column:
    """Numbers with three decimals, as a prompt shows them."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.format_string("%.3f", v.cast("double")) for v in values]), F.lit("]"))


def vocabulary(words: Column, concepts: list[tuple[str, tuple[str, ...]]], always: tuple[str, ...]) -> Column:
    """Names of the concepts that a bag of words triggers, in their order, and those that are always looked for."""
    kept = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, triggers))), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for name, triggers in concepts]
    return F.concat(*kept, F.array(*map(F.lit, always)))


def is_idle(c: Column) -> Column:
    """Texts that say that nothing is to be done."""
    return F.trim(F.lower(text(c))).isin(*IDLE)


def event_text(online: Column, recorded: Column) -> Column:
    """The online text, or the recorded one where that is idle; null where both are."""
    return F.when(~is_idle(online), online).when(~is_idle(recorded), recorded)


def embedded_number(c: Column) -> Column:
    """The first number in a name, to sort names by."""
    return F.nullif(F.regexp_extract(text(c), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; the second one's values win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
