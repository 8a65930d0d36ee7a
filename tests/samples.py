"""Key-shaped values, put together at run time."""

from scanloom.sources.corpus import fake_token

OPENAI = fake_token("sk-" + "proj-", 22)
GITHUB = fake_token("gh" + "p_", 36)
GITHUB_FINE = fake_token("github" + "_pat_", 34)
GOOGLE = fake_token("AI" + "za", 37)
AWS = fake_token("AK" + "IA", 16, "1234567890ABCD12")
KEY_BLOCK = "-----BEGIN " + "PRIVATE KEY-----"
STRIPE_TEST = "sk_" + "test_"
