"""Rule dimensions: classified, audited and exempt symbols as small tables of fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of effect, in this order from 0.
KINDS = ("opaque", "standard_input", "formatted_output", "environment", "file_io", "filesystem_mutation", "path_mutation", "test_runtime", "network", "plugin", "native", "linkage", "unaudited_standard")
KIND = {k: i for i, k in enumerate(KINDS)}

# Fixed values: (packages, symbols, kind, what the reason says of it).
EFFECT_RULES = (
    (
        ("fmt",),
        ("Scan", "Scanf", "Scanln", "Fscan", "Fscanf", "Fscanln"),
        "standard_input", "standard input",
    ),
    (
        ("fmt",),
        ("Print", "Printf", "Println", "Fprint", "Fprintf", "Fprintln"),
        "formatted_output", "formatted output",
    ),
    (
        ("os",),
        ("Getenv", "LookupEnv", "Environ", "ExpandEnv"),
        "environment", "environment input",
    ),
    (
        ("os",),
        ("Open", "OpenFile", "ReadFile", "ReadDir", "Stat", "Lstat"),
        "file_io", "file I/O",
    ),
    (
        ("os",),
        ("Create", "CreateTemp", "WriteFile"),
        "filesystem_mutation", "filesystem mutation",
    ),
    (
        ("os",),
        ("CopyFS", "Link", "Mkdir", "MkdirAll", "MkdirTemp", "Remove", "RemoveAll", "Rename", "Symlink"),
        "path_mutation", "path mutation",
    ),
    (
        ("syscall", "golang.org/x/sys/unix"),
        ("Creat",),
        "filesystem_mutation", "filesystem mutation",
    ),
    (
        ("syscall", "golang.org/x/sys/unix"),
        ("Link", "Linkat", "Mkdir", "Mkdirat", "Rename", "Renameat", "Renameat2", "Rmdir", "Symlink", "Symlinkat", "Unlink",
         "Unlinkat"),
        "path_mutation", "path mutation",
    ),
    (
        ("testing",),
        ("TempDir", "Chdir", "Setenv"),
        "path_mutation", "process or path mutation",
    ),
    (
        ("testing",),
        ("Short", "Verbose", "Testing", "CoverMode", "Coverage", "Deadline", "N", "Loop", "Parallel", "ArtifactDir", "Context"),
        "test_runtime", "test runtime configuration",
    ),
    (
        ("testing",),
        ("Run", "Fuzz", "RunParallel", "Elapsed", "Result", "AllocsPerRun", "Benchmark", "RunBenchmarks", "RunExamples",
         "RunTests", "Main", "MainStart"),
        "test_runtime", "test runtime execution",
    ),
    (
        ("net",),
        ("Dial", "DialContext", "DialTCP", "DialUDP", "DialIP", "Listen", "ListenTCP", "ListenUDP", "ListenIP", "ListenPacket"),
        "network", "network I/O",
    ),
    (
        ("net/http",),
        ("Get", "Head", "Post", "PostForm", "Do", "ListenAndServe", "ListenAndServeTLS", "Serve", "ServeTLS"),
        "network", "network I/O",
    ),
    (
        ("html/template", "text/template"),
        ("ParseFiles", "ParseGlob"),
        "file_io", "file I/O",
    ),
    (
        ("plugin",),
        ("Open", "Lookup"),
        "plugin", "",
    ),
)
# Harness logging.
HARNESS_LOGGING = ("Fatal", "Fatalf", "Error", "Errorf", "Log", "Logf", "Skip", "Skipf", "SkipNow", "Fail", "FailNow")
# Symbols that only compute.
PURE_RULES = (
    ("fmt", ("Sprint", "Sprintf", "Sprintln", "Errorf", "Append", "Appendf", "Appendln", "FormatString", "Stringer")),
    ("math/big", ("NewInt", "NewFloat", "NewRat", "Int", "Float", "Rat")),
    ("time", ("Date", "Time", "Month", "January", "February", "March", "April", "May", "June", "July", "August", "September",
     "October", "November", "December")),
)
# Audited locks and pools.
SYNC_RULES = (
    ("sync", ("Mutex", "RWMutex", "Lock", "Unlock", "RLock", "RUnlock", "TryLock", "TryRLock", "Pool", "Get", "Put")),
)
# Audited reflection.
RUNTIME_TYPE_RULES = (
    ("reflect", ("Type", "TypeOf", "DeepEqual")),
)
# Standard packages that compute only.
SOURCE_ONLY = ("bufio", "bytes", "cmp", "container/heap", "container/list", "container/ring", "crypto/hmac", "crypto/md5",
 "crypto/sha1", "crypto/sha256", "crypto/sha512", "crypto/subtle", "encoding", "encoding/asn1", "encoding/base64",
 "encoding/binary", "encoding/csv", "encoding/hex", "encoding/json", "encoding/pem", "encoding/xml", "errors", "hash",
 "hash/adler32", "hash/crc32", "hash/crc64", "hash/fnv", "io", "io/fs", "iter", "maps", "math/bits", "path", "regexp",
 "regexp/syntax", "slices", "sort", "strconv", "strings", "text/scanner", "unicode", "unicode/utf16", "unicode/utf8")
# What a scan of a package does not block on.
SCAN_EXEMPT = (
    ("testing", ("Run", "Fuzz", "TempDir")),
    ("runtime", ("GOROOT",)),
    ("fmt", ("Fprint", "Fprintf", "Fprintln")),
    ("path/filepath", ("Join",)),
    ("os", ("O_RDONLY", "O_WRONLY", "O_RDWR", "O_APPEND", "O_CREATE", "O_EXCL", "O_SYNC", "O_TRUNC")),
    ("os", ("Getenv", "LookupEnv", "Open", "OpenFile", "ReadFile", "ReadDir", "WriteFile", "Remove", "RemoveAll")),
    ("unsafe", ("Pointer",)),
)
RECEIVER_ESCAPE = "testing runtime value escapes analyzable receiver"


def effect_rules(spark: SparkSession) -> DataFrame:
    rows = []
    for packages, symbols, kind, says in EFFECT_RULES:
        for p in packages:
            rows += [(p, s, KIND[kind], f"reaches {p}.{s}" + (f" ({says})" if says else "")) for s in symbols]
    return spark.createDataFrame(rows, "pkg string, symbol string, kind int, reason string")


def symbol_rules(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([(p, s) for p, symbols in rules for s in symbols], "pkg string, symbol string")


def pure_rules(spark: SparkSession) -> DataFrame:
    return symbol_rules(spark, PURE_RULES + SYNC_RULES + RUNTIME_TYPE_RULES)


def scan_exempt(spark: SparkSession) -> DataFrame:
    return symbol_rules(spark, SCAN_EXEMPT)


def always_external(pkg: Column) -> Column:
    """Packages that reach outside whatever is called."""
    return pkg.isin("plugin", "syscall", "net") | F.startswith(pkg, F.lit("golang.org/x/sys/")) | F.startswith(pkg, F.lit("net/"))


def source_only(pkg: Column) -> Column:
    return pkg.isin(*SOURCE_ONLY)


def fallback_exempt(pkg: Column) -> Column:
    return (pkg == "testing") | source_only(pkg)


def harness_root(name: Column) -> Column:
    """Names that a test binary runs: the word alone, or followed by other than a lower-case letter."""
    return F.coalesce(name.rlike(r"^(Test|Benchmark|Fuzz|Example)($|[^\p{Ll}])"), F.lit(False))


def cause_rank(kind: Column, package_path: Column, observable: Column) -> Column:
    """From -1, an admitted harness fact, to 4, structure and mutation."""
    runtime = kind == KIND["test_runtime"]
    return (
        F.when(runtime & F.coalesce(observable, F.lit(False)), -1)
        .when(runtime & (F.coalesce(package_path, F.lit("")) == ""), 4)
        .when(kind.isin(KIND["unaudited_standard"], KIND["test_runtime"]), 0)
        .when(kind.isin(KIND["formatted_output"], KIND["environment"]), 1)
        .when(kind == KIND["file_io"], 3)
        .otherwise(4)
    )


#: Fixed value: generators whose output is audited, the longer name first.
PROTO_GENERATORS = ("protoc-gen-go-grpc", "protoc-gen-go")


def generated_by(line: Column) -> Column:
    """The audited generator that a comment line names, or ''; other names that begin like one are not audited."""
    closed = F.coalesce(line.rlike(r"DO NOT EDIT\.\s*$"), F.lit(False))
    name = F.regexp_extract(line, rf"^// Code generated by ({'|'.join(PROTO_GENERATORS)})[. \t]", 1)
    return F.when(closed, name).otherwise("")


def has_directive(lines: Column, directive: str) -> Column:
    """A documentation line that is the directive, to the letter."""
    return F.coalesce(F.exists(lines, lambda x: x == directive), F.lit(False))


def includes(text: Column) -> Column:
    """Quoted and other operands of C include and import lines: comments out, continued lines joined."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\\r?\n", ""), r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")
    return F.regexp_extract_all(plain, F.lit(r'(?m)^[ \t]*#[ \t]*(?:include|import)[ \t]*("[^"\n]*"|\S+)'), F.lit(1))
