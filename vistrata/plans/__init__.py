"""Session settings, materialisation and plan inspection."""
