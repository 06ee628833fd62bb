"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

PROFILES_CSV = "id bigint, name string, core_skills string, secondary_skills string, soft_skills string, years_of_experience double, potential_roles string, skill_summary string"
DEMANDS_CSV = "id string, state string, city string, country string, job_title string, primary_skills string, secondary_skills string, experience_lower int, experience_upper int, designation string"
PROFILES = "id string, raw_id bigint, name string, years_experience double, potential_roles array<string>, skill_summary string, canonical_text string"
PROFILE_SKILLS = "person_id string, skill_id string, skill_name string, category string, proficiency_label string, proficiency int, source string"
JOBS = (
    "id string, source string, raw_id string, title string, designation string, industry string, city string, country string, experience_lower int, experience_upper int, "
    "responsibilities array<string>, educational_qualifications array<string>, other_requirements string, raw_text string, enhanced_text string, canonical_text string"
)
JOB_SKILLS = "job_id string, skill_id string, skill_name string, priority string, category string, source string"
QUERIES = (
    "qid string, task string, text string, anchor_id string, query_skills array<string>, min_proficiency_ordinal int, anchor_skill_count int, designation string, stratum string, paraphrase_style string, source_qid string"
)
PARAPHRASES = "source_qid string, paraphrased_qid string, task string, anchor_id string, original_text string, paraphrased_text string, style string, query_skills array<string>"

# Proficiency labels by ordinal, and category and priority weights of the graph channel.
PROFICIENCY = ("Beginner", "Advanced Beginner", "Competent", "Proficient", "Expert")
CATEGORY_WEIGHT = {"core": 3.0, "secondary": 1.5, "soft": 0.5}
PRIORITY_WEIGHT = {"must_have": 3.0, "good_to_have": 1.0}
