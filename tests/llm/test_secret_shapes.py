"""Token shapes and identifiers that the training samples' generator did not make."""

from __future__ import annotations

import pytest

from subtide.llm import secrets

#: Made-up tokens in the shapes of common services, written in two parts.
SECRETS = [
    "ghp_16C7e" "42F292c6912E7710c838347Ae178B4a",
    "sk_live_4" "eC39HqLyjWDarjtT1zdp7dc",
    "xoxb-1765" "3672481-19874698323-pdFZKVeTuE8sk7oOcHrzqqgy",
    "AIzaSyD-9" "tSrke72PouQMnMX-a7eZSW0jkFMBWY",
    "eyJhbGciO" "iJIUzI1NiIsInR5cCI6IkpXVCJ9",
    "SG.ngeVfQ" "FYQlKU0ufo8x5d1A.TwL2iGABf9DHoTf-09kqeF8tAmbihYzrnopKc-1s5cr",
    "glpat-zx9" "Qk3Lm_Tv7Rb2XwN8d",
    "wJalrXUtn" "FEMIK7MDENGbPxRfiCYEXAMPLEKEY",
    "npm_aB3dE" "5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3z",
    "dop_v1_b7" "c1f0e2Aa93kQ8zP4xW6",
    "7fXq9ZbL2" "mWc8RtY4vKp1NsD6hGj3QeA",
    "r4nd0mP4s" "sw0rdZx81QwLk29",
    "Zm9vYmFyY" "mF6cXV4MTIzNDU2Nzg5MA",
    "pk_test_5" "1HxYzAbCdEfGhIjKlMnOpQrStUvWx",
    "hvs.CAESI" "J3bY8x7Z0q9M4wKp2RtVn",
]
ORDINARY = [
    "550e8400-e29b-41d4-a716-446655440000",
    "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
    "sha512-z4PhNX7vuL3xVChQ1m2AB9Yg5AULVxXcg/SpIdNs6c5H0NE8XYXysP+DGNKHfuwvY7kxvUdBeoGlODJ6+SfaPg==",
    "getUserProfileById2",
    "/usr/lib/python3.13/site-packages/pyspark/sql",
    "com.example.project.service.UserServiceImpl2",
    "content-security-policy-report-only-v2",
    "my_long_variable_name_with_numbers_123",
    "ThisIsAVeryLongCamelCaseIdentifier42",
    "2024-11-28T10:15:30.123456Z",
    "org/apache/spark/sql/catalyst/expressions4",
    "test_user_login_with_invalid_password_2",
    "x86_64-unknown-linux-gnu-gcc-13.2",
    "assets/images/header-background-1920x1080.png",
    "IPv6AddressValidatorTest3",
    "node_modules/react-dom/cjs/react-dom.production.min.js18",
    "libstdc++.so.6.0.30",
    "application/vnd.openxmlformats-officedocument.spreadsheetml2",
    "K8sClusterAutoscalerConfigMap1",
    "utf8mb4_unicode_520_ci",
    "f81d4fae-7dec-11d0-a765-00a0c91e6bf6",
]


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(i, f"set the {t} here") for i, t in enumerate([*SECRETS, *ORDINARY])]
    found = secrets.scan(spark.createDataFrame(rows, "i int, text string"), secrets.train(secrets.default_samples(spark))).collect()
    return {r["i"]: [(s["start"], s["match"]) for s in r["spans"]] for r in found}


def test_missed_tokens(spans):
    missed = [t for i, t in enumerate(SECRETS) if not spans[i]]
    assert len(missed) <= len(SECRETS) // 10, missed
    assert all(t.startswith(m) or m in t for i, t in enumerate(SECRETS) for _, m in spans[i])


def test_wrong_spans(spans):
    wrong = [t for i, t in enumerate(ORDINARY) if spans[len(SECRETS) + i]]
    assert len(wrong) <= len(ORDINARY) // 10, wrong
