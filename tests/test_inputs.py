import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import bracket, inputs, manifest

STATES = "path string, exists boolean, kind string"


def log(spark, lines, process="p"):
    rows = [(process, i, x if isinstance(x, bytes) else x.encode()) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "process string, seq bigint, line binary")


def ingest(spark, lines, states=(), recordless=(), excluded=(), declared=(), pwd=False, module="/m", start="/m/pkg"):
    ops = inputs.parse(log(spark, lines))
    ops = inputs.working_directories(ops, spark.createDataFrame([("p", start)], "process string, package_dir string")).withColumn("ambiguous", F.lit(False))
    path = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    rows = inputs.contributions(ops, spark.createDataFrame(list(states), STATES), module, path(recordless), path(excluded), path(declared), spark.createDataFrame([("p",)] if pwd else [], "process string"))
    return {(r.kind, r.ident) for r in inputs.first_seen(rows).collect()}


UNV = "unverifiable"


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        (["# test log", "getenv A", "getenv A", "getenv B"], {("env", "A"), ("env", "B")}),
        ([""], {(UNV, "malformed testlog line")}),
        (["# x"], {(UNV, "malformed testlog line")}),
        (["open"], {(UNV, "malformed testlog line")}),
        (["open "], {(UNV, "malformed testlog line")}),
        (["write f"], {(UNV, "unrecognized testlog op: write")}),
        ([b"open \xff"], {(UNV, "non-UTF-8 testlog line")}),
        (["getenv PWD"], {(UNV, "process-local environment input: PWD")}),
        (["open data.txt"], {("rel", "pkg/data.txt")}),
        (["open ../x/./y"], {("rel", "x/y")}),
        (["open /proc/self/stat"], {(UNV, "volatile OS input: /proc/self/stat")}),
        (["open /proc/cpuinfo"], {("abs", "/proc/cpuinfo")}),
        (["open /etc/dir"], {(UNV, "external directory input: /etc/dir")}),
        (["open /etc/unknown"], {(UNV, "unhashable runtime input: /etc/unknown")}),
        (["open /etc/file"], {("abs", "/etc/file")}),
        (["open /dev/null", "open /quiet/x", "open /m/out"], set()),
        (["stat /etc/dir"], {("abs", "/etc/dir")}),
        (["stat /etc/none"], {("abs", "/etc/none")}),
        (["stat /m/a"], {("rel", "a"), (UNV, "stat metadata input: a")}),
        (["stat /m/bracketed"], {("rel", "bracketed")}),
        (["chdir /m/sub", "open f"], {("rel", "sub"), ("rel", "sub/f"), (UNV, "working-directory change"), (UNV, "relative runtime input after working-directory change: sub/f")}),
        (["chdir sub", "chdir ..", "open f"], {("rel", "pkg/sub"), ("rel", "pkg"), ("rel", "pkg/f"), (UNV, "working-directory change"), (UNV, "relative runtime input after working-directory change: pkg/f")}),
        (["chdir /m/out"], {(UNV, "working-directory change")}),
    ],
)
def test_ingest(spark, lines, expected):
    states = [("/proc/cpuinfo", True, "file"), ("/etc/dir", True, "dir"), ("/etc/file", True, "file"), ("/etc/none", False, None)]
    assert ingest(spark, lines, states, ["/quiet/x"], ["/m/out"], ["/m/bracketed"]) == expected


def test_truthful_pwd_is_recordless(spark):
    assert ingest(spark, ["getenv PWD"], pwd=True) == set()


def test_unterminated_logs(spark):
    ends = spark.createDataFrame([("a", 5, True), ("b", 5, False), ("c", 0, False)], "process string, size bigint, ends_with_newline boolean")
    assert {r.process for r in inputs.unterminated(ends).collect()} == {"b"}


def test_ephemeral_roots(spark):
    objects = spark.createDataFrame([("/tmp", True), ("/tmp/x", True), ("/tmp/y", False), ("/m/z", False), ("/tmpx", False)], "path string, exists boolean")
    roots = spark.createDataFrame([("/tmp",), ("/m",)], "path string")
    assert {r.path for r in inputs.ephemeral(objects, roots, "/m").collect()} == {"/tmp", "/tmp/y"}


def test_coverage_needs_the_object_and_every_link(spark):
    objects = spark.createDataFrame([("a", "/r/x", []), ("b", "/r/x", ["/other/l"]), ("c", "/s/x", None), ("d", None, []), ("e", "/r", ["/r/l", "/r2/l"])], "id string, resolved string, links array<string>")
    found = {r.id: (r.covered, r.escaped) for r in bracket.covered(objects, spark.createDataFrame([("/r",), ("/r2",)], "root string")).collect()}
    assert found == {"a": (True, None), "b": (False, "/other/l"), "c": (False, None), "d": (False, None), "e": (True, None)}


def test_guard_coverage_wants_one_root_for_all(spark):
    objects = spark.createDataFrame(
        [("/go/a", "/go/a", [], True), ("/go/l", "/mod/b", ["/go/l"], True), ("/go/none", "/go/none", [], False), ("/mod/cache/x", "/mod/cache/x", [], True), ("/link/a", "/go/a", ["/link/a"], True), ("/out", "/out", [], True)],
        "path string, resolved string, links array<string>, exists boolean",
    )
    roots = spark.createDataFrame([("/link", "/go", None), ("/mod", "/mod", "cache")], "root string, resolved_root string, exclude_sub string")
    assert {r.path for r in bracket.guard_covered(objects, roots).collect()} == {"/go/a", "/link/a"}


def test_bracket_fingerprints_and_revalidation(spark):
    rows = [("b", "r1", "m1", "d1"), ("b", "r1", "m2", "d2"), ("b", "r2", "m", "d")]
    s = "bracket string, root string, member string, digest string"
    roots, whole = bracket.fingerprint(spark.createDataFrame(rows, s))
    again, same = bracket.fingerprint(spark.createDataFrame(rows[::-1], s))
    assert whole.first().fingerprint == same.first().fingerprint
    assert bracket.revalidate(roots, again).first().reason == ""
    moved, _ = bracket.fingerprint(spark.createDataFrame([*rows[:2], ("b", "r2", "m", "x")], s))
    assert bracket.revalidate(roots, moved).first().reason == "bracket root moved: r2"


E = "manifest_id string, kind string, ident string, digest string"
DIGEST = "0" * 32


def test_codec_is_canonical(spark):
    rows = [("m", "env", "B", DIGEST), ("m", "env", "A", DIGEST), ("m", "rel", "x/y", DIGEST), ("m", "unverifiable", "why", None)]
    folded = manifest.fold(spark.createDataFrame(rows, E)).first()
    back = manifest.explode(spark.createDataFrame([("m", folded.manifest)], "manifest_id string, manifest string")).collect()
    assert {(r.kind, r.ident, r.digest) for r in back} == {r[1:] for r in rows}
    assert (folded.unverifiable, folded.reason) == (True, "why")
    import base64

    text = base64.urlsafe_b64decode(folded.manifest + "=" * (-len(folded.manifest) % 4)).decode()
    assert [e["n"] for e in json.loads(text)["env"]] == ["A", "B"]
    enc = lambda t: base64.urlsafe_b64encode(t.encode()).rstrip(b"=").decode()
    bad = [enc(text.replace('"v":1', '"v":2')), enc(text[:-1] + ',"z":1}'), enc(text.replace('"A"', '"Z"')), enc(text + " "), folded.manifest + "=", "!", "", enc(text.replace("x/y", "../y"))]
    df = spark.createDataFrame([(b,) for b in bad], "m string")
    assert [r.d for r in df.select(manifest.decode(F.col("m")).alias("d")).collect()] == [None] * len(bad)


def test_merge_laws(spark):
    rng = random.Random(2)
    some = lambda: [("g", rng.choice(["env", "rel"]), rng.choice("abcd"), DIGEST) for _ in range(4)]
    a, b, c = (spark.createDataFrame(some(), "g string, kind string, ident string, digest string") for _ in range(3))
    fold = lambda *dfs: manifest.fold(manifest.merge(__import__("functools").reduce(lambda x, y: x.unionByName(y), dfs), "g")).first().digest
    assert fold(a, b, c) == fold(c, a, b) == fold(b, b, a, c, a)


def test_entries_digest_present_state(spark):
    observed = spark.createDataFrame([("m", "env", "A"), ("m", "rel", "f"), ("m", "rel", "gone"), ("m", "abs", "/odd"), ("m", "abs", "/d")], "manifest_id string, kind string, ident string")
    env = spark.createDataFrame([("A", "1", True)], "key string, value string, present boolean")
    st = "path string, exists boolean, kind string, size bigint, mode bigint, mtime_ns bigint, content_sha string"
    states = [("f", True, "file", 3, 420, 7, "sha"), ("gone", False, None, None, None, None, None), ("/odd", True, "other", 0, 0, 0, None), ("/d", True, "dir", 0, 0, 0, None)]
    now = manifest.entries(observed, env, spark.createDataFrame(states, st), F.lit("machine"))
    rows = {(r.kind, r.ident): r.digest for r in now.collect()}
    assert set(rows) == {("env", "A"), ("rel", "f"), ("rel", "gone"), ("abs", "/d"), ("unverifiable", "unhashable runtime input: /odd")}
    states[0] = ("f", True, "file", 3, 420, 8, "sha")
    later = manifest.entries(observed, env, spark.createDataFrame(states, st), F.lit("machine"))
    assert [(r.kind, r.ident) for r in manifest.moved(now, later).collect()] == [("rel", "f")]


def test_rejects_and_absolute(spark):
    df = spark.createDataFrame([("m", "env", "A", DIGEST), ("m", "env", "A", DIGEST), ("m", "rel", "x", "short"), ("m", "odd", "y", DIGEST), ("m", "rel", "../z", DIGEST)], E)
    assert {(r.ident, r.why) for r in manifest.rejects(df).collect()} == {("A", "duplicate identity"), ("x", "digest shape"), ("y", "unknown kind")}
    got = {(r.kind, r.ident) for r in manifest.absolute(df.filter("kind = 'rel'"), F.lit("/m")).collect()}
    assert got == {("abs", "/m/x"), ("unverifiable", "relative path escapes module: ../z")}


def test_merges_refuse_what_moved_and_conflicting_processes(spark):
    other = "f" * 32
    rows = [("g", "m1", "env", "A", DIGEST), ("g", "m2", "env", "A", DIGEST), ("h", "m3", "rel", "f", DIGEST), ("i", "m4", "rel", "x", DIGEST)]
    df = spark.createDataFrame(rows, "g string, manifest_id string, kind string, ident string, digest string")
    now = spark.createDataFrame([("m1", "env", "A", DIGEST), ("m2", "env", "A", DIGEST), ("m3", "rel", "f", other), ("m4", "rel", "x", DIGEST)], E)
    told = spark.createDataFrame([("g", "p", "o", "v"), ("g", "p", "o", "v"), ("i", "q", "o", "v"), ("i", "q", "o2", "v")], "g string, process string, origin string, view string")
    merged, refused = manifest.merge_checked(df, "g", now, told)
    assert {(r.manifest_id, r.ident) for r in merged.collect()} == {("g", "A")}
    assert {(r.g, r.reason) for r in refused.collect()} == {("h", "merge input moved: m3"), ("i", "conflicting observations for process q")}


def test_dirty_gives_no_answer_for_what_moved(spark):
    rows = spark.createDataFrame([("m", "rel", "a", DIGEST), ("n", "rel", "a", DIGEST), ("o", "abs", "/b", DIGEST)], E)
    now = spark.createDataFrame([("m", "rel", "a", DIGEST), ("n", "rel", "a", "f" * 32), ("o", "abs", "/b", DIGEST)], E)
    commit = spark.createDataFrame([("a", False)], "ident string, reproducible boolean")
    assert {r.manifest_id: r.dirty for r in manifest.dirty(rows, commit, now).collect()} == {"m": True, "n": None, "o": False}


def test_paths_that_lead_outside_the_module(spark):
    observed = spark.createDataFrame([("m", "rel", x) for x in ("in", "file", "dir", "gone")], "manifest_id string, kind string, ident string")
    states = [("in", True, "file", 1, 420, 1, "s", "/mod/in"), ("file", True, "file", 1, 420, 1, "s", "/else/f"), ("dir", True, "dir", 1, 420, 1, "s", "/else"), ("gone", False, None, None, None, None, None, None)]
    st = spark.createDataFrame(states, "path string, exists boolean, kind string, size bigint, mode bigint, mtime_ns bigint, content_sha string, resolved string")
    env = spark.createDataFrame([], "key string, value string, present boolean")
    got = {(r.kind, r.ident) for r in manifest.entries(observed, env, st, F.lit("machine"), "/mod").collect()}
    assert got == {("rel", "in"), ("rel", "gone"), ("unverifiable", "external runtime input target: file"), ("unverifiable", "external directory input: dir")}


def test_seals_cover_members(spark):
    from evidentia.operators import bracket

    schema_ = "bracket string, module string, roots array<string>, exclusions array<string>, fingerprint string, members array<struct<root:string,member:string>>"
    rows = [("a", [("r", "x"), ("r", "y")]), ("b", [("r", "y"), ("r", "x")]), ("c", [("r", "x")]), ("d", [("r", "x"), ("q", "y")]), ("e", [("r", "x1:y")])]
    df = spark.createDataFrame([(k, "/m", ["r"], [], "f", m) for k, m in rows], schema_)
    seals = {r.bracket: r.seal for r in bracket.seal(df).collect()}
    assert seals["a"] == seals["b"] and len(set(seals.values())) == 4
