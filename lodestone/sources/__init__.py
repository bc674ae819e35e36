"""Providers of evidence: git history, SARIF results, Python calls, project manifests and symbol indexes."""
