"""SQL parameters.

Two forms are supported:

* text templating: ``${NAME}`` (``NAME`` = word characters) is replaced by the
  value's SQL text before Spark sees the statement.  Like any text templating
  it is not injection safe; use it for trusted fragments only.
* typed arguments: ``:name`` markers bound by Spark itself through
  ``spark.sql(text, args=...)``; values travel as typed literals, and a table
  name can be bound with ``IDENTIFIER(:name)``.

``${a.b}`` (a dot in the name) is not ours: it is left for Spark's own variable
substitution (``${spark.some.conf}``).
"""

from __future__ import annotations

import re
from typing import Any, Mapping

# Fixed value: the placeholder syntax, ``${`` + word characters + ``}``.
_PLACEHOLDER = re.compile(r"\$\{(\w+)\}")


class ParameterError(ValueError):
    pass


def value_text(value: Any) -> str:
    """SQL text for one templated value (the text is pasted verbatim)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def substitute(text: str, parameters: Mapping[str, Any] | None) -> str:
    """Replace every ``${NAME}``; an undefined name is an error even when no
    parameters are given at all, since Spark would otherwise turn it into an
    empty string silently.  One pass only: a value's own text is not
    re-scanned, and a placeholder that appears inside a value is an error."""
    params = dict(parameters or {})
    used: list[str] = []

    def repl(m: re.Match[str]) -> str:
        name = m.group(1)
        if name not in params:
            raise ParameterError(
                f"undefined parameter '${{{name}}}'; defined: {sorted(params)}")
        used.append(name)
        return value_text(params[name])

    out = _PLACEHOLDER.sub(repl, text)
    for name in used:
        if _PLACEHOLDER.search(value_text(params[name])):
            raise ParameterError(
                f"value of parameter '{name}' holds a placeholder itself")
    return out


def placeholders(text: str) -> list[str]:
    """Names of the ``${NAME}`` placeholders in ``text``, in order."""
    return _PLACEHOLDER.findall(text)
