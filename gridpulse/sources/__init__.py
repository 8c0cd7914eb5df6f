"""gridpulse.sources"""
