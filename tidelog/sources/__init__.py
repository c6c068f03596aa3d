from .buckets import normalize_buckets
from .catalog import (
    choose_sources,
    describe_schema,
    known_formats,
    nested_keys,
    list_sources,
    sample_entry,
    source_health,
    union_sources,
)
from .exports import (
    normalize_cloudwatch,
    normalize_cloudwatch_events,
    normalize_datadog,
    normalize_loki,
)
from .lines import (
    LineOptions,
    log_files,
    parse_json_lines,
    parse_lines,
    parse_regex_lines,
    plain_lines,
    read_log_lines,
    to_entry,
)
from .tables import read_log_table, write_log_table
