"""End-to-end flows, and the tables the checks run on."""
