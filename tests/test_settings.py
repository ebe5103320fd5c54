"""Settings files."""

from __future__ import annotations

import pytest

from sessionloom.functions import text as X
from sessionloom.operators import sessions
from sessionloom.sources import settings


def test_settings_of_a_file(spark, tmp_path):
    (tmp_path / "config.json").write_text('{"keyPatterns": ["\\\\bAB-\\\\d+\\\\b", "#\\\\d{2,6}"], "ignoreBranches": [" staging ", "", "main"]}')
    found = settings.read(spark, str(tmp_path / "config.json"))
    assert found.generic == (*X.GENERIC_BRANCHES, "staging")
    rows = spark.createDataFrame([("s", 0, "see AB-1 and #77", "staging")], "session_id string, turn int, text string, branch string")
    assert rows.select(X.find_keys("text", found.pattern).alias("k")).first().k == ["AB-1", "#77"]
    assert sessions.detect_keys(rows, None, found.generic, "NONE-1").first().key == sessions.UNASSIGNED
    assert settings.read(spark, str(tmp_path / "none.json")) == settings.Settings()


@pytest.mark.parametrize("text, named", [("{", "no JSON"), ("[]", "JSON object"), ('{"keyPatterns": []}', "keyPatterns"), ('{"keyPatterns": ["ok", " "]}', "keyPatterns"), ('{"keyPatterns": ["a(b"]}', "a(b"), ('{"ignoreBranches": "x"}', "ignoreBranches"), ('{"keyPatterns": ["' + "a" * 301 + '"]}', "300")])
def test_what_is_wrong_is_named(text, named):
    with pytest.raises(ValueError, match=named.replace("(", "\\(")):
        settings.parse(text, "config.json")
