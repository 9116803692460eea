"""Explicit schemas of the relations."""

CODE_BLOCK = "struct<language:string,content:string>"
TABLE = "struct<headers:array<string>,rows:array<array<string>>,caption:string>"
ELEMENT = "struct<pos:int,type:string,content:string,order:int,language:string,title:string,context:string>"
SECTION_FIELDS = (
    f"id string, title string, level int, section_number string, breadcrumb string, content string, mixed array<{ELEMENT}>, code_blocks array<{CODE_BLOCK}>, tables array<{TABLE}>, pos int"
)
NODES = "node int, parent int, depth int, end int, tag string, classes array<string>, attrs map<string,string>, text string, has_children boolean"
TOC = "id string, title string, level int, href string, full_text string"
PATTERNS = "pattern_id string, frequency bigint"
RULES = "type_ord int, rule_ord int, content_type string, selector_type string, selector_value string"
DECISIONS = "pattern_id string, selector_type string, selector_value string, frequency bigint, evidence_score double, sample_content string, suggested_type string, human_decision string, notes string"
API_TYPE = (
    "struct<`type-name`:string,`full-type-name`:string,description:string,`base-type-full-name`:string,fields:array<struct<`field-name`:string,`field-description`:string>>,"
    "properties:array<struct<`property-name`:string,`property-description`:string,`property-short-type-name`:string>>,"
    "methods:array<struct<`method-name`:string,`method-description`:string,`method-return-short-type-name`:string>>>"
)
PARSED_SECTION = f"struct<id:string,title:string,level:int,section_number:string,breadcrumb:string,mixed_content:array<{ELEMENT.replace('pos:int,', '')}>,tables:array<{TABLE}>,parent_id:string>"
PARSED_FILE = f"source_file string, document_index int, total_documents_in_file int, parse_timestamp string, sections array<{PARSED_SECTION}>"
CHUNKS = "chunk_index int, total_chunks int, chunk_type string, strategy string, section_id string, section_title string, section_path string, level int, parent_id string, language string, has_code boolean, has_table boolean, start_char int, end_char int, content string, quality_score double"
