"""Tables in the shared folder come and go."""

import os
from urllib.parse import urlparse

from corvid.storage import discard, fresh_path, remembered, stored


def test_discard_deletes_what_was_made(spark):
    discard(spark)
    kept = stored(spark.range(5), "numbers")
    folder = os.path.dirname(urlparse(kept.inputFiles()[0]).path)
    assert kept.count() == 5 and os.path.isdir(folder)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    assert discard(spark) == 3 and not os.path.exists(folder) and discard(spark) == 0


def test_remembered_until_it_is_gone(spark):
    made = []

    def make():
        made.append(stored(spark.range(3), "kept"))
        return made[-1]

    assert remembered(spark, ("k",), make) is remembered(spark, ("k",), make)
    discard(spark)
    assert remembered(spark, ("k",), make).count() == 3 and len(made) == 2
    import shutil

    shutil.rmtree(made[-1].inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert remembered(spark, ("k",), make).count() == 3 and len(made) == 3
