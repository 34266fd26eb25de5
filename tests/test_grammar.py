"""Invocations against small grammars."""

from corvid.operators.grammar import SCHEMA, as_of, newest, validated

_none, _value = ("none", None), ("required", None)
GRAMMARS = [
    ("t", "1", "", {"-a": _none, "-b": _value, "--verbose": _none, "--when": ("attached", ["always", "never"]), "-x": _none}, ["-x", "--exec"], True, None, False, True, True, True),
    ("u", "1", "", {"-c": _value}, [], False, ["one"], False, True, False, False),
    ("u", "1", "one", {}, [], False, ["two"], True, False, False, False),
    ("u", "1", "one/two", {"-z": _none}, [], True, None, False, False, False, False),
]
CASES = [
    ("t", "-a -b -b -a y", ("valid", None, None)),
    ("t", "-b -b -b", ("valid", None, None)),  # the third one waits for a value
    ("t", "-b -- -- -q", ("valid", None, None)),
    ("t", "-- -q -b", ("valid", None, None)),
    ("t", "-q", ("invalid", 1, "flag")),
    ("t", "- x", ("valid", None, None)),
    ("t", "-abvalue -a", ("valid", None, None)),
    ("t", "-ab -q -q", ("invalid", 3, "flag")),
    ("t", "-aq", ("invalid", 1, "flag")),
    ("t", "-ax", ("unknown", 1, "opaque")),
    ("t", "--exec q", ("unknown", 1, "opaque")),
    ("t", "--verb", ("unknown", 1, "abbreviated")),
    ("t", "--verbose=1", ("unknown", 1, "attached")),
    ("t", "--when x --when=never", ("valid", None, None)),
    ("t", "--when=later", ("invalid", 1, "value")),
    ("t", "-b=x --none", ("invalid", 2, "flag")),
    ("t", "", ("valid", None, None)),
    ("t", None, ("unknown", None, "words")),
    ("u", "-c one one two -z", ("valid", None, None)),
    ("u", "one two x", ("unknown", 3, "positional")),
    ("u", "one two -y", ("invalid", 3, "flag")),
    ("u", "one three", ("invalid", 2, "subcommand")),
    ("u", "other", ("unknown", 1, "subcommands")),
    ("u", "-y", ("unknown", 1, "flags")),
    ("w", "-y", ("unknown", None, "grammar")),
]


def test_words_are_held_against_grammars(spark):
    rows = [(k, tool, "1", None if text is None else text.split(), "clash") for k, (tool, text, _) in enumerate(CASES)]
    rows += [(1000, "t", "1", ["-b"] * 20_001 + ["-a", "-q"], ""), (1001, "t", None, [], ""), (1002, "t", "1", ["-a", None], "")]
    asked = spark.createDataFrame(rows, "key int, tool string, version string, words array<string>, flags string")
    grammars = spark.createDataFrame(GRAMMARS, SCHEMA)
    got = {r.key: (r.answer, r.pos, r.why) for r in validated(asked, grammars).collect()}
    assert {k: got[k] for k in range(len(CASES))} == {k: found for k, (_, _, found) in enumerate(CASES)}
    assert got[1000] == ("invalid", 20_003, "flag") and got[1001] == ("unknown", None, "grammar") and got[1002] == ("unknown", None, "words")
    assert len(got) == len(rows)
    assert validated(asked.limit(0), grammars).count() == 0


def test_versions_are_ordered_by_their_numbers(spark):
    have = spark.createDataFrame([("t", "1.9p2"), ("t", "1.10"), ("t", "1.9"), ("v", "99999999999999999999"), ("v", "x")], "tool string, version string")
    assert {(r.tool, r.version) for r in newest(have).collect()} == {("t", "1.10"), ("v", "99999999999999999999")}
    wanted = spark.createDataFrame([("t", "1.9p1"), ("t", "1.11"), ("t", "1"), ("z", "1"), ("t", None), ("t", "1.11")], "tool string, version string")
    assert {(r.tool, r.version, r.known) for r in as_of(wanted, have).collect()} == {("t", "1.9p1", "1.9"), ("t", "1.11", "1.10"), ("t", "1", None), ("z", "1", None), ("t", None, None)}
