"""Preference formatting with clashing column names, missing and repeated ids, and very long texts."""

from thermoflux.llm import chat_format

LONG = "long text é " * 40_000


def whole(turns):
    return "".join(f"<|im_start|>{r or 'null'}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_edges(spark):
    turns = [
        (1, 0, "user", "q"), (1, 1, "assistant", LONG), (2, 0, "user", "q"), (2, 1, "assistant", LONG), (2, 2, "user", "more"),
        (None, 0, "user", "no id"), (None, 0, "user", "no id"), (None, 1, "assistant", "still one"), (3, 0, "user", "twice"), (3, 0, "user", "twice"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"),
    ]
    df = spark.createDataFrame([(*t, "x", 1, "y") for t in turns], "conv_id long, turn long, role string, text string, prompt string, _rank int, turns string")
    got = chat_format.format_pairs(chat_format.pair_conversations(df)).collect()
    sides = {}
    for r in got:
        for side in ("chosen", "rejected"):
            if r[f"{side}_id"] is not None or side == "chosen":
                sides[r[f"{side}_id"]] = (r["prompt"], r[side], r[f"{side}_mask"])
    assert set(sides) == {1, 2, 3, None}
    for conv, (prompt, rest, mask) in sides.items():
        own = sorted((t[1:] for t in turns if t[0] == conv), key=lambda t: (t[0], t[1], t[2]))
        assert prompt + rest == whole([t[1:] for t in own])
        assert all(rest[m["start"] : m["end"]].endswith("<|im_end|>") for m in mask)
    # the pair of long texts shares its first two turns, whichever of them is chosen
    assert sides[1][0] == sides[2][0] == whole([("user", "q"), ("assistant", LONG)]) and {sides[1][1], sides[2][1]} == {"", whole([("user", "more")])}


def test_added_columns_replace_those_of_the_pairs(spark):
    pair = [([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")], 7, "old", "old")]
    kind = "array<struct<role:string,text:string>>"
    out = chat_format.format_pairs(spark.createDataFrame(pair, f"chosen_turns {kind}, rejected_turns {kind}, id int, prompt string, n_common string"))
    assert out.columns.count("prompt") == 1 and out.columns.count("n_common") == 1
    r = out.first()
    assert (r["id"], r["n_common"], r["prompt"]) == (7, 1, whole([("user", "a")])) and r["rejected"] == whole([("assistant", "c")])
