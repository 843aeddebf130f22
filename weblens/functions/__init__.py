"""Column functions; all stay inside whole-stage code generation."""

from weblens.functions.display import cell_text, human_size, status_class, truncate_text
from weblens.functions.requests import action_of, classify_request, repository_of
from weblens.functions.times import clf_time, iso_time, offset_seconds, without_zone, zone_offset

__all__ = [
    "action_of", "cell_text", "classify_request", "clf_time", "human_size", "iso_time",
    "offset_seconds", "repository_of", "status_class", "truncate_text", "without_zone",
    "zone_offset",
]
