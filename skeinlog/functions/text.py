"""Text of numbers, durations and events, as reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def minutes(seconds: Column) -> Column:
    """M:SS."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def spoken(seconds: Column) -> Column:
    """45s, 3m 20s or 2h 5m."""
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def clock(ts: Column) -> Column:
    """HH:MM:SS of the log's clock."""
    s = F.floor(ts % 86400)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def event_line(short: bool = False) -> Column:
    """An entry as text; short leaves out school, mitigation and overheal."""
    crit = "if(is_crit, ' (crit)', '')"
    parts = "''" if short else """concat(if(school is null, '', concat(' ', school)),
        if(absorbed > 0, concat(' (', absorbed, ' absorbed)'), ''), if(resisted > 0, concat(' (', resisted, ' resisted)'), ''), if(blocked > 0, concat(' (', blocked, ' blocked)'), ''))"""
    over = "''" if short else "if(overheal > 0, concat(' (', overheal, ' overheal)'), '')"
    return F.expr(f"""case kind
        when 'Damage' then concat(source, "'s ", spell, ' hits ', target, ' for ', amount, {parts}, {crit})
        when 'Healing' then concat(source, "'s ", spell, ' heals ', target, ' for ', effective_heal, {over}, {crit})
        when 'Death' then concat(source, ' dies')
        when 'Dispel' then concat(source, ' dispels ', spell, ' on ', target)
        when 'Resurrect' then concat(source, ' resurrects ', target, ' with ', spell)
        when 'Interrupt' then concat(source, ' interrupts ', target, ' with ', spell)
        when 'AuraGain' then concat(source, ' gains ', spell, if(stacks > 1, concat(' (', stacks, ')'), ''))
        when 'AuraFade' then concat(spell, ' fades from ', source) end""")
