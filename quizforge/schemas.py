"""Explicit schemas of the tables."""

ITEMS = "id string, split string, question string, correct string, distractors array<string>, support string, grounded boolean"
RAW = "question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string, support string"
OBJECTIVES = "subject string, subject_name string, unit_id string, unit_name string, unit_weight double, topic_id string, topic_name string, lo_id string, text string, keywords array<string>, bloom string"
REQUEST = "struct<subject string, unit string, topic string, lo_id string, lo_text string, difficulty string, format string, passage string, target_misconception string, avoid array<string>>"
GENERATIONS = "id string, arm string, text string, seconds double, generation_tokens long, generation_tps double, retried boolean, first_parsed boolean, peak_memory_gb double"
JUDGED = "id string, arm string, majority string, agrees boolean, p_key double, duplicate_options boolean"
SAMPLES = "id string, shots int, idx int, sha string, model string, adapter string, seed long, temperature double, text string"
RESPONSES = "session string, seq int, item string, lo string, unit string, b double, choice string, correct boolean, created timestamp"
ITEM_STATS = "item_id string, b double, b_label double, n long, n_correct long"
CHAT = "messages array<struct<role string, content string>>"
BLOOM = ("remember", "understand", "apply", "analyze", "evaluate", "create")
