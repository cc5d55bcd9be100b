from __future__ import annotations

from ledgerlark.plans import host_list, html_rows, table_bodies

from .conftest import rows

PAGE = """
<table><thead><tr><td>head</td></tr></thead>
<TBODY class="x">
<tr><td>1.1.1.1</td><td>80</td><td>FR</td><td>France</td><td>e</td><td>no</td><td class="hx">yes</td></tr>
<tr><td>2.2.2.2</td><td>81</td><td>US</td><td>States</td><td>e</td><td>no</td><td>yes</td></tr>
<tr><td>3.3.3.3</td><td>82</td><td>DE</td><td>Germany</td><td>e</td><td>no</td><td>no</td></tr>
<tr><td>4.4.4.4</td><td>83</td><td>CH</td><td>x</td><td>e</td><td>no</td><td>yes, maybe</td></tr>
<tr><td>5.5.5.5</td></tr>
</TBODY></table>
"""


def test_hosts_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>no table</p>"), (3, None)], "page_id int, html string")
    found = html_rows(table_bodies(pages))
    assert found.count() == 5
    assert found.columns == ["page_id", "cells"]
    assert rows(host_list(found)) == [(1, "1.1.1.1:80")]
    assert rows(host_list(found, ["US"])) == [(1, "2.2.2.2:81")]


def test_other_patterns(spark):
    pages = spark.createDataFrame([("<ul><li><b>x</b>|<b>y</b></li><li></li></ul>",)], "html string")
    out = html_rows(pages, r"(?s)<li>(.*?)</li>", r"<b>(.*?)</b>")
    assert rows(out) == [(["x", "y"],), ([],)]
