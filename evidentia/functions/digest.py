"""Digests and the byte-exact frames that are folded into them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE, NUL = "\n", "\0"


def short(x: Column) -> Column:
    """The first 32 hex digits of SHA-256; of a string, over its UTF-8 bytes. Null stays null."""
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 32)


def framed(*parts: Column) -> Column:
    """Each part as its length in bytes, a colon and itself; null counts as empty."""
    whole = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*[x for p in whole for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def file_line(name: Column, content_sha: Column) -> Column:
    return F.concat(name, F.lit(NUL), content_sha, F.lit(NEWLINE))


def fold(lines: Column, distinct: bool = True) -> Column:
    """Aggregate: the group's lines, sorted by bytes and joined by newlines, as a short digest. A group of no lines has
    none, nor has one with a line that is null (something that could not be read): null, which no comparison takes for
    equal."""
    gathered = F.array_sort(F.collect_set(lines) if distinct else F.collect_list(lines))
    return F.when((F.size(gathered) > 0) & whole(lines), short(F.array_join(gathered, NEWLINE)))


def whole(lines: Column) -> Column:
    """Aggregate: no line of the group is null."""
    return F.count(F.lit(1)) == F.count(lines)


def base64url(x: Column) -> Column:
    """Without padding and line breaks."""
    return F.rtrim(F.translate(F.base64(x.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def from_base64url(x: Column) -> Column:
    """Null where it is not base64url."""
    plain = F.translate(x, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(x.rlike(r"^[A-Za-z0-9_-]*$") & (F.length(x) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def env_entry(value: Column) -> Column:
    """Of an environment variable: presence and the value's hash, never the value."""
    return short(F.concat(F.when(value.isNull(), F.lit("false")).otherwise(F.lit("true")), F.lit(" "), F.sha2(F.coalesce(value, F.lit("")).cast("binary"), 256)))


def valid_entry(digest: Column) -> Column:
    return F.coalesce(digest.rlike(r"^[0-9a-f]{32}$"), F.lit(False))


#: The keys of the build and run-time configuration digests.
BUILD_ENV_KEYS = ("GOOS", "GOARCH", "GOAMD64", "GOARM", "GOARM64", "GO386", "GOEXPERIMENT", "CGO_ENABLED", "CGO_CFLAGS", "CGO_CPPFLAGS", "CGO_CXXFLAGS", "CGO_FFLAGS", "CGO_LDFLAGS", "CC", "CXX", "PKG_CONFIG", "GOFLAGS")
BUILD_OS_KEYS = ("PKG_CONFIG_PATH", "PKG_CONFIG_LIBDIR", "PKG_CONFIG_SYSROOT_DIR")
RUNTIME_KEYS = ("GOGC", "GODEBUG", "GOMEMLIMIT", "GOMAXPROCS")


def _get(env: Column, key: str) -> Column:
    return F.coalesce(F.element_at(env, key), F.lit(""))


def build_config(env: Column, build_inputs: Column) -> Column:
    """env: map<string,string>; build_inputs: array<string>, in the caller's order."""
    lines = [F.concat(F.lit(f"env {len(k)}:{k} "), F.octet_length(_get(env, k)).cast("string"), F.lit(":"), _get(env, k), F.lit(NEWLINE)) for k in sorted(BUILD_ENV_KEYS + BUILD_OS_KEYS)]
    given = F.transform(F.coalesce(build_inputs, F.array().cast("array<string>")), lambda x: F.concat(F.lit("buildinput "), F.octet_length(x).cast("string"), F.lit(":"), x, F.lit(NEWLINE)))
    return short(F.concat(*lines, F.array_join(given, "")))


def runtime_config(env: Column) -> Column:
    return short(F.concat(*[F.concat(F.lit(f"{k}="), _get(env, k), F.lit(NEWLINE)) for k in RUNTIME_KEYS]))


def machine(facts: dict[str, Column]) -> Column:
    """Digest of the machine facts as JSON. The encoder escapes <, > and & within strings; to_json does not."""
    text = F.to_json(F.struct(*[v.alias(k) for k, v in facts.items()]), {"ignoreNullFields": "false"})
    for plain, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return short(text)


def toolchain(version_line: Column) -> Column:
    return F.regexp_replace(F.trim(version_line), "^go version ", "")


def method_mask(names: Column) -> Column:
    """Aggregate: a bit for each method name's CRC-32 modulo 64; a prefilter for implements()."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.crc32(names.cast("binary")) % 64).cast("int")))
