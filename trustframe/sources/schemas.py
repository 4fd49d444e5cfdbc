"""Explicit schemas of the record files. Nothing is inferred; open tails are string maps."""

CASE = (
    "case_id string, query string, documents array<struct<document_id:string,text:string,metadata:map<string,string>>>, "
    "metadata map<string,string>, relevant_document_ids array<string>, retrieved_document_ids array<string>, "
    "answer string, expected_decision string")

SAMPLE = (
    "id string, lang string, question string, contexts array<struct<doc_id:string,text:string,title:string,source:string,"
    "license:string,metadata:map<string,string>>>, answer string, reference_answer string, gold struct<claims:array<struct<"
    "claim_id:string,text:string,label:string,evidence:array<struct<doc_id:string,start:int,end:int>>>>,"
    "unsupported_spans:array<struct<start:int,end:int,text:string>>>, metadata map<string,string>")

TRACE = (
    "trace_id string, span_id string, parent_span_id string, stage string, event string, timestamp timestamp, "
    "duration_ms double, attributes map<string,string>")

LEDGER_LINE = (
    "query_id string, prove struct<proved:array<string>,rejected:array<string>,undecidable:array<string>>, timestamp string")

FACT = (
    "tenant_id string, ontology_id string, ontology_version string, subject string, relation string, object string, "
    "fact_type string, state string, confidence double, source string, valid_from timestamp, valid_until timestamp, "
    "policy_id string, policy_version string, provenance struct<source:string,document_id:string,chunk_id:string,"
    "span_start:int,span_end:int,source_uri:string,extractor:string>, aliases array<string>, metadata map<string,string>, "
    "created_at timestamp")

FACT_FILE = (
    "domain string, source string, facts array<struct<subject:string,relation:string,object:string,state:string>>")

RULE = (
    "rule_id string, standard string, description string, patterns array<string>, severity string, remediation string, "
    "is_regex boolean, context_required array<string>, exceptions array<string>, scope string, enabled boolean")

ANNOTATION = (
    "sample_id string, claim_id string, claim_text string, context_text string, seed_label string, "
    "annotator_1_label string, annotator_2_label string, adjudicated_label string, notes string")

REVIEW = (
    "sample_id string, workflow string, expected_decision string, observed_decision string, proof_lookup_ok boolean, "
    "audit_minutes_before double, audit_minutes_after double, setup_minutes double, usefulness_score double")

DECISION = (
    "decision string, recommended_action string, confidence double, status string, subject string, "
    "evidence array<struct<evidence_id:string,text:string,span_start:int,span_end:int,score:double>>")
