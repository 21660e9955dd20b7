"""The row types of the engine, as DDL."""

SOURCE = "id string, layer string, kind string, title int, part string, name string, why string, url string, jurisdiction string, status string, withdrawn_note string, unresolved_note string"
PARAGRAPH = "source_id string, part string, part_title string, sec_ord int, section string, section_heading string, citation string, para_ord int, text string"
UNIT = "source_id string, part string, part_title string, section string, section_heading string, citation string, subsection string, text string, jurisdiction string, status string, layer_ord int, file_ord string, unit_ord long"
UNIT_COLUMNS = [x.split()[0] for x in UNIT.split(", ")]
CHUNK_COLUMNS = ["chunk_id", "strategy", "embed_text", "body", "source_id", "citations", "n_tokens", "jurisdiction", "status", "source_ids", "statuses", "jurisdictions", "ord"]
MATCHER = "struct<citation:string,citation_contains:string,source_id:string>"
GOLDEN = f"id string, type string, question string, expect array<{MATCHER}>, why string"
METRIC = "scope string, metric string, value double"
#: Question types whose right answer is to decline.
ABSTAIN_TYPES = ["refusal", "out_of_scope"]
