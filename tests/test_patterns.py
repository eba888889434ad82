"""Patterns of the decoder: the same matches as the plain forms of the grammar, and lines of any length."""

import random
import re

from minilog import at
from pyspark.sql import functions as F

from skeinlog.functions import decode as D

# The plain forms, with repeated groups that give back.
WHO = r"[A-Za-z]+(?:\s[A-Za-z]+)*"
PLAIN = {
    "DAMAGE_SPELL": rf"({WHO}(?:\s*\([^)]+\))?) 's (?:\(pet\) )?([A-Za-z\s']+) (?:hits|crits) ([A-Za-z\s']+) for (\d+)",
    "DAMAGE_MELEE": rf"({WHO}) (?:hits|crits) ([A-Za-z\s']+) for (\d+)\.",
    "DAMAGE_TICK": rf"([A-Za-z\s']+) suffers (\d+) (?:\w+ )?damage from ({WHO}(?:\s*\([^)]+\))?) 's (?:\(pet\) )?([A-Za-z\s']+)",
    "HEAL_DIRECT": rf"({WHO}(?:\s*\([^)]+\))?) 's ([A-Za-z\s']+) (?:heals|critically heals) ([A-Za-z\s']+(?:\s*\([^)]+\))?) for (\d+)",
    "HEAL_TICK": rf"({WHO}(?:\s*\([^)]+\))?) gains (\d+) health from ({WHO}(?:\s*\([^)]+\))?) 's ([A-Za-z\s']+)",
    "CAST_RANK": rf"CAST:\s*({WHO})\s+(?:casts|begins to cast)\s+([A-Za-z][A-Za-z '\-]+?)(?:\(\d+\))+\(Rank (\d+)\)",
    "CAST": r"(?:CAST:\s*)?([A-Za-z]+)\s+casts\s+([A-Za-z\s]+?)(?:\(\d+\))?(?:\(Rank \d+\))?\s+on\s+([A-Za-z\s]+)",
    "DODGE": r"([A-Za-z\s']+) attacks\. ([A-Za-z]+) dodges\.",
    "MISS": r"([A-Za-z\s']+) misses ([A-Za-z]+)\.",
    "AURA_GAIN": r"([A-Za-z]+) gains ([A-Za-z\s':]+?) \((\d+)\)\.",
    "AURA_FADE": r"([A-Za-z\s':]+?) fades from ([A-Za-z]+)\.",
    "AFFLICTED": r"([A-Za-z]+) is afflicted by ([A-Za-z\s':]+?)(?:\s+\((\d+)\))?\.",
    "CONSUMABLE": r"([A-Za-z]+) uses ([A-Za-z][A-Za-z '\-]+?)(?:\s+on\s+[A-Za-z\s]+)?\.",
    "PET_OWNER": r"([A-Za-z]+)\s+\(([A-Za-z]+)\)",
}
#: Lines in the right order; @ stands for a few words.
FORMS = {
    "DAMAGE_SPELL": "@| 's |(pet) |@| hits |@| for |5|.", "DAMAGE_MELEE": "@| hits |@| for |5|.", "DAMAGE_TICK": "@| suffers |5| Fire| damage from |@| 's |(pet) |@", "HEAL_DIRECT": "@| (x)| 's |@| critically heals |@| (x y)| for |5",
    "HEAL_TICK": "@| (x)| gains |5| health from |@| (x)| 's |@", "CAST_RANK": "CAST: |@| casts |@|(1)|(Rank 2)", "CAST": "CAST:|@| casts |@|(1)|(Rank 2)| on |@", "DODGE": "@| attacks. |@| dodges.", "MISS": "@| misses |@|.",
    "AURA_GAIN": "@| gains |@| (2).", "AURA_FADE": "@| fades from |@|.", "AFFLICTED": "@| is afflicted by |@| (3)|.", "CONSUMABLE": "@| uses |@| on |@|.", "PET_OWNER": "@| (|@|)",
}
WORDS = ("Ann", "Bog Lord", "Kel'Thuzad", "a", "hits", " ", "  ", "'", "7", "12.", "(Ann)", "on", "casts", "Pow: R", "-")


def test_patterns_match_as_their_plain_forms(spark):
    r = random.Random(11)
    for name, plain in PLAIN.items():
        parts, texts = FORMS[name].split("|"), []
        words = lambda: "".join(r.choice((*WORDS, *parts) if r.random() < 0.3 else ("Ann", "Bog Lord")) + r.choice(["", " "]) for _ in range(r.choice([1, 1, 2, 4]))).replace("@", "").strip(r.choice(["", " "]))
        for _ in range(1500):
            texts.append("1/2 3:4:5.6  " + "".join(words() if p == "@" else p for p in parts if r.random() < 0.97) + r.choice(["", " " + words()]))
        pattern = getattr(D, name)
        groups = re.compile(plain).groups
        new = "|".join(f"${k + 1}" for k in range(groups))
        made = (D.named_captures if "{who}" in pattern else D.captures)(F.col("t"), pattern, new)
        got = [x.g for x in spark.createDataFrame([(t,) for t in texts], "t string").select(made.alias("g")).collect()]
        want = [None if (m := re.search(plain, t, re.ASCII)) is None else [x or "" for x in m.groups()] for t in texts]
        assert 100 < sum(w is not None for w in want) < len(want), name
        for t, g, w in zip(texts, got, want, strict=True):
            assert g == w, (name, t, g, w)


def test_lines_of_any_length(spark):
    n = 150_000
    many, one, gap = "Bog " * n, "a" * n * 4, "Bog  Lord " * n
    verbs = (" 's Slam hits Boss for 5.", " hits Boss for 5.", " 's Heal heals Ann for 5.", " gains 5 health from Ann 's Heal.", " gains Might (1).", " is afflicted by Rot (2).", " attacks. Ann dodges.", " misses Ann.", " fades from Ann.", " uses Flask.", " casts Cleanse on Ann.", " (Ann)")
    texts = [at(0, x.strip() + v) for x in (many, one, gap) for v in verbs] + [at(0, "Boss suffers 5 damage from " + x.strip() + " 's Rot.") for x in (many, one, gap)]
    texts += [at(0, "CAST: " + x.strip() + " casts Heal" + "(1)" * n + "(Rank 4) on Ann.") for x in (many, one)]
    lines = spark.createDataFrame([("a", 0, k, t) for k, t in enumerate(texts)], "log_id string, session_id int, seq long, text string")
    d = D.decode(lines).select("seq", F.length("damage.source").alias("hit"), F.length("heal.source").alias("heal"), F.length("rank.source").alias("rank")).orderBy("seq").collect()
    assert len(d) == len(texts)
    assert (d[0].hit, d[1].hit, d[2].heal) == (4 * n - 1,) * 3
    assert d[-1]["rank"] == 4 * n and d[-2]["rank"] == 4 * n - 1
