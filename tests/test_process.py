import random

import pytest
from pyspark.sql import functions as F

from bytewake.functions import process


def apply(spark, function, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numbers_merge_and_words_stay_apart(spark):
    a, b, lint, docs = apply(
        spark, process.normalize_cmdline,
        "cargo watch -j 4 lint", "cargo watch -j 16 lint", "cargo watch lint", "cargo watch docs",
    )
    assert a == b == "cargo watch -j <n> lint"
    assert lint != docs


@pytest.mark.parametrize(
    "raw, masked",
    [
        ("java -Dheap.dir=/var/heap", "java -Dheap.dir=<v>"),
        ("k=v=w", "k=<v>"),
        ("=q", "=<v>"),
        ("job 3f6c1a92-7b0e-4d58-8c21-e94a07d5b16f done", "job <uuid> done"),
        ("3F6C1A92-7B0E-4D58-8C21-E94A07D5B16F", "<uuid>"),
        ("3F6C1A92-7B0E-4D58-8C21-E94A07D5B16X", "3F6C1A92-7B0E-4D58-8C21-E94A07D5B16X"),
        ("tar -xf /tmp/in.tar", "tar -xf <path>"),
        ("head /proc/loadavg /tmp /tmpfs/z", "head <path> /tmp /tmpfs/z"),
        ("ffmpeg -ss 12.75 clip7.mkv", "ffmpeg -ss <n> clip7.mkv"),
        ("8. .25 +6 -4e11 2E+7 inf -Infinity NaN +nan", "<n> <n> <n> <n> <n> <n> <n> <n> <n>"),
        (". e9 2d 2f 3_000 0x2F 4e + - infin", ". e9 2d 2f 3_000 0x2F 4e + - infin"),
        (" x\t yy  z\n", "x yy z"),
        ("", ""),
    ],
)
def test_masking(spark, raw, masked):
    assert apply(spark, process.normalize_cmdline, raw) == [masked]


def test_exe_loses_every_trailing_deleted_mark(spark):
    assert apply(
        spark, process.clean_exe, "/x (deleted) (deleted)", "/x (deleted)/y", "/x(deleted)", "/x (deleted)\n"
    ) == ["/x", "/x (deleted)/y", "/x(deleted)", "/x (deleted)\n"]


def test_arguments_join_without_empty_ones(spark):
    assert apply(spark, process.join_arguments, "app\0\0--x\0a b\0", "", "\0") == ["app --x a b", "", ""]


def test_real_uid(spark):
    assert apply(
        spark, process.real_uid,
        "Name:\tx\nUid:\t1000\t1\t2\n", "Uid: 4294967295", "Uid: 4294967296", "Uid:\n7", "Uid: x\nUid: 5",
        "xUid: 5", None, "Uid: +12 0",
    ) == [1000, 4294967295, None, None, None, None, None, 12]


def test_cgroup_is_third_field_of_first_fitting_line(spark):
    assert apply(
        spark, process.cgroup_path, "0::/user.slice/a.scope\n", "junk\n1:cpu:/a:b\n0::/c", "none", "", "0::\n1::/x"
    ) == ["/user.slice/a.scope", "/a:b", "", "", ""]


def test_comm_is_trimmed_and_cut(spark):
    assert apply(spark, process.clean_comm, " node\n", "a b ") == ["node", "a b"]
    assert apply(spark, process.cut_at_nul, "rsync\0\0\0", "rsync", "\0x") == ["rsync", "rsync", ""]


def test_ancestors_include_the_path_and_the_root(spark):
    assert apply(spark, process.ancestors, "/", "/a", "/a/b/c") == [
        ["/"], ["/", "/a"], ["/", "/a", "/a/b", "/a/b/c"],
    ]


def is_number(token):
    """An independent reading of the rule: what float() takes, in ASCII and without underscores."""
    try:
        float(token)
    except ValueError:
        return False
    return token.isascii() and "_" not in token


def test_number_tokens_against_float(spark):
    rng = random.Random(11)
    words = ["inf", "Infinity", "nan", "NaN", "infinit", "na", "١٢", "1_0", "0x1", "1e5", "-.5E+3"]
    tokens = words + ["+" + w for w in words] + [
        "".join(rng.choice("0123456789..eE+-inf") for _ in range(rng.randint(1, 7))) for _ in range(4000)
    ]
    masked = apply(spark, process.normalize_cmdline, *tokens)
    assert masked == ["<n>" if is_number(t) else t for t in tokens]
