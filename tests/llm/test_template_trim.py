"""White space beside tags with hyphens."""

from __future__ import annotations

from wavefield.llm import templates


def test_hyphens_trim_white_space():
    run = lambda source, **names: "".join(t for t, _ in templates.compile_template(source, {})(names))
    assert run("a \n{%- if x -%}  b {{- y -}} \n c{% endif %} d", x=True, y="Y") == "abYc d"
    assert run("a {% if x %} b {% endif %}d", x=True) == "a  b d"
    assert run("  {{- y }} {{ y -}}  ", y=1) == "1 1"
    assert run("{% for t in ts -%}  {{ t }},{% endfor %}", ts="ab") == "a,b,"
