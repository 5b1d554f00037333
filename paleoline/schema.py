"""The line table's columns."""

from __future__ import annotations

# Names and order of the export's columns.
LINE_COLUMNS = ["id", "doc_id", "file_name", "ancestor_id", "ancestor_type", "facs_id", "image_info_url", "image_jpg_url", "lang", "is_in_note", "contains_abbr", "contains_sic", "source_sic", "source_corr", "target_sic", "target_corr", "nonbreaking_next_line"]
LINE_SCHEMA = ", ".join(f"{c} {'array<string>' if c == 'lang' else 'string'}" for c in LINE_COLUMNS)
