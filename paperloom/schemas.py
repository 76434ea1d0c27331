"""Schemas, declared once; JSON is read with these and never inferred."""

from __future__ import annotations

#: A slide text index: one document of nested maps by relative path and slide number.
SLIDE_INDEX = (
    "kb_root string, last_scan string, total_pptx int, total_slides int, "
    "files map<string, struct<title:string, slide_count:int, path_abs:string, slides:map<string,string>, slide_keywords:map<string,array<string>>>>"
)
#: An image index: entries by key.
IMAGE_INDEX = (
    "index_type string, version string, kb_root string, "
    "images map<string, struct<archive_name:string, archive_path:string, source_file:string, source_filename:string, description_hint:string, context_text:string, search_tags:array<string>, format:string, width:int, height:int, slide_number:string, slide_title:string>>"
)
ENTRY = "source_type string, source_id string, text string, display_text string, title string, file string"
CANDIDATE = "provider string, title string, author string, license string, license_url string, width int, height int, url string"
JOB = "filename string, prompt string, aspect_ratio string, status string"
EDIT = "ts string, file string, element_id string, action string, kind string, key string, old string, new string"
FEEDBACK = "sessions array<struct<timestamp:string, query:string, selected:array<array<string>>, skipped:array<array<string>>, hp_snapshot:map<string,double>>>"
JOB_STATES = ("Pending", "Generated", "Failed", "Needs-Manual", "promoted")
