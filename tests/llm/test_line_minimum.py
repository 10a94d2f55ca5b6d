"""Hosts of every size lose the lines above the ratio; a line on one page repeats nowhere and stays."""

from ratewright.llm import line_dedup


def test_the_ratio_decides_on_hosts_of_every_size(spark):
    pages = [("one", "menu")] + [("two", "menu")] * 2 + [("four", "menu")] * 4
    pages += [("twenty", "menu" if i < 3 else "rare" if i < 5 else f"own {i}") for i in range(20)]
    found = line_dedup.drop_site_lines(spark.createDataFrame(pages, "host string, text string")).collect()
    left = {h: sorted(r.text for r in found if r.host == h and not r.text.startswith("own")) for h in ("one", "two", "four", "twenty")}
    assert left == {"one": ["menu"], "two": ["", ""], "four": [""] * 4, "twenty": ["", "", "", "rare", "rare"]}
    assert sum(r.text.startswith("own") for r in found) == 15
