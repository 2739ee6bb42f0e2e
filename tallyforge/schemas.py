"""Fields, weights, thresholds and table schemas of receipts.  The field's bank reference is ``transaction_id``; the key
of a receipt is ``id`` in its own table and ``txn_pk`` elsewhere."""

from __future__ import annotations

#: Fixed values.
FIELDS = ("transaction_id", "datetime", "from_account", "to_account", "receiver_name", "comment", "amount")
WEIGHTS = {"transaction_id": 2.5, "amount": 2.5, "from_account": 2.0, "to_account": 2.0, "datetime": 1.0, "receiver_name": 0.5, "comment": 0.3}
BANDS = ("transaction_id", "datetime", "from_account", "to_account", "receiver_name", "mobile_number", "comment", "amount")
LABELS = {
    "transaction_id": ("رقمالعملية", "transactionid"),
    "datetime": ("التاريخوالزمن", "date"),
    "from_account": ("منحساب", "from"),
    "to_account": ("إلىحساب", "الىحساب", "to"),
    "receiver_name": ("اسمالمرسلاليه", "name"),
    "comment": ("التعليق", "comment"),
    "amount": ("المبلغ", "amount"),
}
REVIEW_BELOW = {"transaction_id": 0.90, "amount": 0.90, "from_account": 0.85, "to_account": 0.85, "datetime": 0.70, "receiver_name": 0.70, "comment": 0.70}

#: A field of a result.
FIELD = "struct<value:string,confidence:double,raw_text:string,needs_review:boolean>"

TRANSACTIONS = "id long, filename string, receipt_type string, created_at timestamp_ntz, processed_at timestamp_ntz, overall_confidence double, needs_review int, status string"
TRANSACTION_FIELDS = "field_id long, transaction_id long, field_name string, field_value string, raw_value string, ocr_confidence double, manually_edited int, edited_at timestamp_ntz"
ISSUES = "issue_id long, transaction_id long, field_name string, severity string, message string, resolved int"
ENTITIES = "entity_type string, value string, display_name string, frequency long, last_seen timestamp_ntz, verified int"
STATS = "date date, total_processed long, auto_verified long, manually_reviewed long, avg_processing_time double, avg_confidence double"
TOKENS = "image_id string, slice_idx int, field_name string, token_idx int, text string, confidence double, bbox array<array<int>>"
TEMPLATE = "template_name string, description string, receipt_type string, image_dimensions struct<typical_width:int,typical_height:int,note:string>, fields map<string,struct<label_ar:string,region:struct<x:int,y:int,width:int,height:int>,value_position:string,expected_pattern:string,preprocessing:struct<enhance_contrast:boolean,binarize:boolean>>>"
