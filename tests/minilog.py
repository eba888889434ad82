"""Small logs in the log's grammar, and the tables that go with them."""


def lines(spark, *texts, log="a"):
    return spark.createDataFrame([(log, 0, i, t) for i, t in enumerate(texts)], "log_id string, session_id int, seq long, text string")


def at(seconds, payload):
    h, m, s = 20 + int(seconds) // 3600, int(seconds) // 60 % 60, seconds % 60
    return f"1/27 {h}:{m}:{s:06.3f}  {payload}"


def roster(name, klass="WARRIOR", pet="nil", you=False, guid=None):
    gear = "&".join(["47354:1508:0:0", "nil", *["nil"] * 17])
    talents = "nil" if not you else "12}3}0"
    return f"COMBATANT_INFO: 27.01.26 20:00:00&{name}&{klass}&Human&2&{pet}&Guild&Rank&1&{gear}&{talents}&{guid or '0x0000000000000001'}&nil"


def npcs(spark):
    rows = [("bogling", "bog keep", False, None), ("mire lord", "bog keep", True, None), ("left twin", "twin hall", True, "The Twins"), ("right twin", "twin hall", True, "The Twins")]
    return spark.createDataFrame(rows, "npc string, instance string, is_boss boolean, group_name string")


def zones(spark):
    rows = [("bog keep", True, False, False, 1), ("twin hall", True, False, False, 2), ("town", False, False, True, None)]
    return spark.createDataFrame(rows, "zone string, is_instance boolean, is_dungeon boolean, is_overworld boolean, encounter_count int")
