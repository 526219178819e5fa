"""The feature build as one chain: clean and label, schedule hours in UTC, previous-leg features, weather at both ends.

The previous-leg features come before the weather joins, so that the lag shuffles narrow rows. An airport
without a time zone stops the build: its hours would be null without a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from contrail.operators.labels import make_target
from contrail.operators.legs import cascade_features
from contrail.operators.schedule import refuse_unknown, schedule_hours
from contrail.operators.weather import join_weather_both, prepare_weather


def build_features(legs: DataFrame, weather: DataFrame, values: list[str], target: str = "disrupted") -> DataFrame:
    """Labelled legs with UTC hours, previous-leg features and weather columns; one row for each leg kept.

    ``weather`` may hold several observations of an airport-hour; the one with the smallest ``event_id`` counts.
    """
    kept = make_target(legs, target)
    timed = cascade_features(schedule_hours(refuse_unknown(kept, "Dest")))
    return join_weather_both(timed, prepare_weather(weather, values), values)
