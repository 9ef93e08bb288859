"""Two-stage models, cross-fitting, residual correctors and their kin, on Spark ML."""
