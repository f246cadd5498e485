"""The agent index against the Column expression, and its speed on a registry of 1,539 entries."""

import random
import time

from pyspark.sql import functions as F

from hitscope import registry
from hitscope.functions.agent_index import AgentIndex, classified, needed
from hitscope.functions.agents import classify

BROWSERS = ["Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{}.0 Safari/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_{} like Mac OS X) AppleWebKit/605.1.15 Mobile"]


def entry(bot, kind, *patterns, operator="op"):
    return {"bot_id": bot, "operator": operator, "actor_type": kind, "ua_patterns": list(patterns)}


def large_registry(n=1539):
    """As many entries as a full registry has: half tokens, half patterns of the kinds that crawler lists use."""
    shapes = [r"Crawl{0}\/[0-9]+", r"^Fetcher{0}[ \/]", r"(?:Agent|Client){0}(?:-mobile)?", r"[Tt]ool{0}\b", r"Robo{0}(bot)?\/"]
    return registry.entries() + [entry(f"e{i}", "seo_tool", f"Token{i}x" if i % 2 else shapes[i // 2 % len(shapes)].format(i)) for i in range(n - len(registry.entries()))]


def test_needed_literals():
    assert needed(r"^Foo\/[0-9]+") == {"Foo/"}
    assert needed(r"(?:alpha|beta)x?") == {"alpha", "beta"}
    assert needed(r"a[bc]d") == set() and needed(r"(?i)alpha") == set() and needed(r"(alpha)?") == set()
    assert needed(r"ab(cde)+f") == {"cde"}


def test_same_as_the_expression(spark):
    bots = [
        entry("strong", "ai_training", "StrongBot"), entry("longer", "ai_search", "StrongBot-News"), entry("rx", "seo_tool", r"^Rx\/[0-9]+"), entry("group", "seo_tool", r"(Gr)oup[0-9]"), entry("late", "social", r"oup[0-9]"),
        entry("weak", "monitoring", "Zyx"), entry("vague", "ai_training", "Spider"), entry("bad", "social", "(?<x"), entry("unknown", "other_bot", "Nameless", operator="unknown"), entry("any", "social", r"[0-9]{9}"), entry("twice", "social", "strongbot"),
    ]
    r = random.Random(2)
    pieces = ["strongbot", "StrongBot-News", "-", "/", "Rx/1", "rx/1", "Group7", "zyx", "ZYX", "spider", "Cubot", "CUBOT", "bot", "bot;", "bots", "curl/8", "crawl", "é", "İ", "ſ", " ", "Firefox", "nameless", "123456789", "headlessChrome"]
    uas = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 5))) for _ in range(1500)] + [None, "", " - ", "-"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uas)], "i int, ua string")
    got = {x["i"]: (x["actor_type"], x["bot_id"], x["operator"]) for x in classified(df, bots).collect()}
    expected = {x["i"]: tuple(x["c"]) for x in df.select("i", classify(F.col("ua"), bots).alias("c")).collect()}
    assert got == expected


def test_speed():
    """BASELINE's floor: 10,000 agents a second on one core, 70 % people, 1,539 entries, none twice."""
    bots = large_registry()
    assert len(bots) == 1539
    r = random.Random(1)
    uas = [r.choice(BROWSERS).format(i) if i % 10 < 7 else f"Mozilla/5.0 (compatible; {r.choice(['Token%dx', 'Crawl%d/1', 'GPTBot/%d', 'Robo%d/2', 'Something%d'])}; +http://h.example/{i})" % r.randrange(1500) for i in range(30_000)]
    index = AgentIndex(bots)
    for u in uas[:3000]:
        index.of(u)
    start = time.process_time()
    kinds = [index.of(u)[0] for u in uas]
    rate = len(uas) / (time.process_time() - start)
    print(f"{rate:.0f} agents a second")
    assert 20_000 < kinds.count("human") < 27_000 and kinds.count("seo_tool") > 1_000 and kinds.count("ai_training") > 1_000
    assert rate > 10_000
