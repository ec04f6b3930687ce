"""What the modules may not contain."""

import os

import bytewake.llm

FOLDER = os.path.dirname(bytewake.llm.__file__)
NATIVE = ("secret_scan.py", "line_dedup.py")


def test_no_cross_joins_no_local_state_and_native_where_asked():
    for name in sorted(os.listdir(FOLDER)):
        if not name.endswith(".py"):
            continue
        with open(os.path.join(FOLDER, name)) as file:
            text = file.read()
        for word in ("crossJoin", "localCheckpoint", "toPandas", ".sample(", "tempfile"):
            assert word not in text, (name, word)
        if name in NATIVE:
            for word in ("udf", "InArrow", "InPandas", "applyIn", ".rdd", "pandas", "pyarrow", "numpy"):
                assert word not in text, (name, word)
