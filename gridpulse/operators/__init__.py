"""gridpulse.operators"""
