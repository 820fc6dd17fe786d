"""All thirteen operators and the pipeline are registered, so that a mistyped import cannot pass for a subpackage that is not there."""

import re

import __spark_entry__


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {int(m.group(1)) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert {f"op{n}" for n in (1, 2, 3, 5, 7, 10, 11, 12, 13)} == {n.split("_")[0] for n in __spark_entry__.oracle_sql() if re.match(r"op\d+_", n)}
