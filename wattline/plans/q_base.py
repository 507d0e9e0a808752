"""The engine tables themselves."""

from wattline.plans.base import query
from wattline.sources import tables as tb

query("x01_series_batch", "SELECT * FROM series", use="series", rd="load")(tb.series)
query("i07_filled_grid", "SELECT * FROM filled", use="filled", rd="load")(tb.filled)
query("daily_series", "SELECT * FROM daily", use="daily", rd="load")(tb.daily)
query("j06_scored", "SELECT * FROM scored", use="scored", rd="yhat y")(tb.scored)
