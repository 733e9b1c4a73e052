"""Part of the planning library; see README.md."""
