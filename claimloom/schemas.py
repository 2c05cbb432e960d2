"""Record types, as DDL, and closed value sets."""

# Closed sets.
CLAIM_TYPES = ("chain_offer", "health", "policy", "attribution", "money", "statistic", "event", "causal", "prediction", "generic")
SOURCE_TYPES = ("factcheck", "web", "seed_index", "image", "reverse_image")
RATINGS = ("false", "misleading", "true", "unknown")
STANCES = ("supports", "refutes", "neutral")
VERDICTS = ("false", "misleading", "disputed", "true", "unverified")
NODE_KINDS = ("claim", "image", "entity", "source", "evidence", "event", "date", "verdict")

IMAGE = "path string, ocr_text string, description string, embedding array<float>, exif_date string, ai_generated_score double, frame_time double"
_INSIDE = ", ".join(c.replace(" ", ":", 1) for c in IMAGE.split(", "))
PACKET = f"packet_id string, input_type string, text string, source_date string, images array<struct<{_INSIDE}>>"
ENTITY = "id string, text string, label string, normalized string, start int, end int"
TIME_REF = "text string, kind string, normalized string, start int, end int"
CLAIM = "packet_id string, claim_id string, pos int, field string, image_index int, text string, normalized_text string, claim_type string, confidence double, check_worthy boolean, language string, attributed_to string, drop_reason string"
QUERY = "claim_id string, rank int, text string, kind string, language string, sites array<string>, claim_type string"
EVIDENCE = "id string, claim_id string, source_type string, url string, title string, snippet string, text string, publisher string, domain string, published_date string, rating string, rating_raw string, score double, source_weight double, decisive boolean, demo boolean, language string, meta map<string,string>"
NODE = "packet_id string, id string, kind string, attrs map<string,string>"
EDGE = "packet_id string, src string, dst string, type string, via string, attrs map<string,string>"
EVAL_CASE = "id string, text string, language string, category string, expect struct<verdict:string,check_worthy:boolean,retrieves:string>, in_corpus boolean, note string"
EVAL_RECORD = "id string, language string, category string, mode string, verdict string, expected_verdict string, check_worthy boolean, expected_check_worthy boolean, expected_seed_id string, retrieved_seed_ids array<string>, in_corpus boolean, ms double, stage_errors map<string,string>"
SEED = "id string, claim string, claim_hi string, rating string, rating_raw string, publisher string, domain string, url string, published_date string, summary string, topics array<string>, demo boolean, demo_note string"
