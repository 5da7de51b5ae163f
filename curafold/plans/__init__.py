"""Multi-step plans: learners, screening, cross-validation, explanation, resumption."""
