"""Schemas of the tables and manifests. Nothing is inferred."""

from __future__ import annotations

PATIENTS = "id string, name string, age int, sex string, status string, admitted_at timestamp, cid_code string, cid_label string, observations string, comorbidities array<string>, current_medications array<string>"
VITAL_SIGNS = "id bigint, patient_id string, blood_pressure string, temperature double, oxygen_saturation int, heart_rate int, recorded_at timestamp"
EXAMS = "id string, patient_id string, name string, requested_at timestamp, status string, result string, interpretation string, source string, protocol_ref string"
EXAM_ATTACHMENTS = "id string, exam_id string, name string, mime string, size bigint, path string"
SUGGESTED_ITEMS = "id string, patient_id string, type string, description string, status string, protocol_ref string"
AGENT_LOG = "id bigint, patient_id string, step string, status string, detail string, timestamp timestamp"
ALERTS = "id string, patient_id string, severity string, category string, message string, team string, created_at timestamp, resolved boolean"

PAGES = "page int, markdown string"
CHUNKS = "text string, metadata struct<source_stem: string, source_pdf: string, section: string, header_1: string, header_2: string, page_start: int, page_end: int, page_range: array<int>, chunk_index: int>"

DOWNLOAD_INDEX = "id string, source_url string, title string, source_description string, fetched_at string, content_type string, bytes bigint, sha256 string, relative_path string, status string, detail string"
EXAMS_INDEX = "id string, source_url string, archive string, title string, fetched_at string, bytes bigint, sha256 string, relative_path string, status string"
EXTRACT_INDEX = "pdf_relative_path string, pages_jsonl_relative_path string, md_relative_path string, wrote_combined_md boolean, status string, error string, sha256 string, extracted_at string"
CHUNK_INDEX = "source_stem string, pages_jsonl_relative_path string, chunks_jsonl_relative_path string, status string, error string, chunk_count int, chunked_at string"
EMBED_INDEX = "source_stem string, chunks_jsonl_relative_path string, embedded_count int, status string, embedded_at string, chunks_mtime_unix double, error string"
EXAM_RESULTS = "ID_PACIENTE string, IC_SEXO string, AA_NASCIMENTO string, CD_UF string, DT_COLETA string, DE_ORIGEM string, DE_EXAME string, DE_ANALITO string, DE_RESULTADO string, CD_UNIDADE string, DE_VALOR_REFERENCIA string"
