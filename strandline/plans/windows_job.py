"""Raw events to labelled windows: 30 days of text, flags for the next 7 days."""

from pyspark.sql import DataFrame

from strandline.operators.events import Route, default_time, route_events
from strandline.operators.labels import Rule, label_events
from strandline.operators.sequences import labelled_windows
from strandline.sources.tables import scan_months


def labelled_events(
    events: DataFrame, routes: dict[str, Route], rules: list[Rule], months: tuple[str, str] | None = None
) -> DataFrame:
    if months:
        events = scan_months(events, *months)
    return label_events(route_events(default_time(events), routes), rules)


def window_dataset(
    events: DataFrame,
    routes: dict[str, Route],
    rules: list[Rule],
    months: tuple[str, str] | None = None,
    **options,
) -> DataFrame:
    """Rows (customer, day, part, x, y) with at least one label in the next days."""
    return labelled_windows(labelled_events(events, routes, rules, months), **options)
