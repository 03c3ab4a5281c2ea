import pytest

from sqlrun import ParameterError, substitute
from sqlrun.functions.params import placeholders, value_text


def test_substitutes_all_placeholders():
    sql = "SELECT * FROM t WHERE d >= '${START}' AND n < ${LIMIT}"
    assert substitute(sql, {"START": "2024-01-01", "LIMIT": 10}) == \
        "SELECT * FROM t WHERE d >= '2024-01-01' AND n < 10"


def test_undefined_name_is_an_error_even_without_parameters():
    with pytest.raises(ParameterError, match="FOO"):
        substitute("SELECT '${FOO}'", {})
    with pytest.raises(ParameterError, match=r"defined: \['A'\]"):
        substitute("SELECT ${B}", {"A": 1})


def test_dotted_names_are_left_for_spark():
    assert substitute("SELECT '${spark.app.name}'", {}) == "SELECT '${spark.app.name}'"


def test_single_pass_and_nested_placeholder_rejected():
    with pytest.raises(ParameterError, match="placeholder"):
        substitute("SELECT ${A}", {"A": "${B}", "B": 1})
    # an unused value holding a placeholder is fine
    assert substitute("SELECT ${B}", {"A": "${B}", "B": 1}) == "SELECT 1"


def test_value_text():
    assert value_text(None) == "NULL"
    assert value_text(True) == "true" and value_text(False) == "false"
    assert value_text(1.5) == "1.5"
    assert placeholders("${A} ${b_1} ${c.d}") == ["A", "b_1"]
