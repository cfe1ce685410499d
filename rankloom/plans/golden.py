"""Nine fixed profiles to evaluate rankings with."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "profile_id string, gpa double, state string, major string, education_level string, citizenship string, today date, interests array<string>, keywords array<string>, extracurriculars array<string>, goals string"
TODAY = date(2026, 2, 22)

# The evaluation profiles.
PROFILES = [
    ("golden_ca_cs_ug_us", 3.85, "CA", "Computer Science", "Undergraduate", "US", ["machine learning", "robotics"], ["python", "ai", "data science"], ["robotics club"], "Build responsible AI systems for healthcare."),
    ("golden_tx_nursing_ug_us", 3.45, "TX", "Nursing", "Undergraduate", "US", ["community health", "public service"], ["nursing", "patient care", "health equity"], ["hospital volunteer"], "Work in underserved rural clinics."),
    ("golden_ny_business_grad_us", 3.72, "NY", "Business", "Graduate", "US", ["entrepreneurship", "finance"], ["startup", "operations", "leadership"], ["startup incubator"], "Launch a sustainable logistics startup."),
    ("golden_il_mech_ug_us", 3.10, "IL", "Mechanical Engineering", "Undergraduate", "US", ["manufacturing", "automation"], ["cad", "robotics", "engineering"], ["maker space"], "Design affordable assistive devices."),
    ("golden_fl_education_ug_us", 3.55, "FL", "Education", "Undergraduate", "US", ["classroom leadership", "literacy"], ["teaching", "education policy", "mentoring"], ["peer tutor"], "Teach middle school literacy in public schools."),
    ("golden_wa_env_grad_us", 3.90, "WA", "Environmental Science", "Graduate", "US", ["climate policy", "field research"], ["sustainability", "climate", "conservation"], ["watershed internship"], "Develop climate adaptation plans for coastal cities."),
    ("golden_az_math_ug_pr", 3.30, "AZ", "Mathematics", "Undergraduate", "Permanent Resident", ["statistics", "applied math"], ["analytics", "modeling", "data"], ["math club"], "Pursue graduate study in biostatistics."),
    ("golden_nc_psych_ug_us", 2.95, "NC", "Psychology", "Undergraduate", "US", ["mental health", "community outreach"], ["psychology", "counseling", "wellness"], ["peer counseling"], "Expand community-based mental health programs."),
    ("nc_cs_rising_sophomore", 3.25, "NC", "Computer Science", "high school", "US", ["programming", "robotics", "game development", "cybersecurity", "math"], ["STEM", "computer science", "engineering", "technology", "coding", "software"], ["robotics club", "math team", "coding bootcamp", "volunteer tutoring"], "Pursuing a degree in Computer Science or Computer Engineering with interest in software development and cybersecurity"),
]


def golden_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p[:6], TODAY, *p[6:]) for p in PROFILES], SCHEMA)
