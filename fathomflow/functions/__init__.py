"""The formula language and scalar expressions."""
