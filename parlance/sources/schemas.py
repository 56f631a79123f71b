"""Declared schemas of the JSON columns and event files; nothing is inferred."""

NLU_RESPONSE = """
consumer_details struct<age_group string, gender string, latest string>,
intents array<struct<intent string>>, subvertical string,
positive struct<aspects array<struct<aspect string>>, brands array<string>, product_type struct<parent_type string>, models array<string>>,
negative struct<aspects array<struct<aspect string>>, brands array<string>, product_types array<struct<parent_type string>>, models array<string>>,
occasion_tags struct<occasions array<string>>, product_search_result array<string>, skus array<string>
"""

NBR_RESPONSE = """
ack_text string,
next_response struct<text string, data struct<response_code string>, possible_values array<array<string>>>
"""

CHANNEL = "platform string, device string, os string, app string"

USER_TURNS = """sender_id long, ga_session_id string, retailer_id int, ts long, text string, json_response string"""
BOT_TURNS = """sender_id long, retailer_id int, ts string, next_response_time string, json_response string"""

QA = """data array<struct<paragraphs array<struct<context string, qas array<struct<
id string, question string, is_impossible boolean, answers array<struct<text string, answer_start int>>>>>>>>"""
